"""The pipeline's stages against brute force on a small table, each on what the one before it kept."""

import random

import pytest

import corpus_pipeline
from moetrace.llm import decontaminate, langid, minhash, packing

from .test_brute import _brute_lines, _edits, _root

ENGLISH = "the of and to in that was for with his they this from have were which there been their would".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(3), []
    item = "which of the following three answers is the one that a careful reader would choose and why"
    for i in range(120):
        words, lang = (ENGLISH, "en") if i % 2 else (GERMAN, "de")
        paragraphs = [" ".join(rng.choice(words) + rng.choice(["", "", "s", "t", "en"]) for _ in range(rng.randrange(10, 60))) for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(paragraphs), lang))
    for i in range(20):
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words), rows[i][2]))
    rows += [(300, "before " + item + " after it all came to an end", "en"), (301, "more " + item.replace("careful", "carefull") + " and so on", "en")]
    rows += [(400, None, "en"), (401, "", "en"), (402, "12 34 !!", None), (5, rows[5][1], "en"), (5, rows[5][1], "en"), (None, " ".join(rng.choice(ENGLISH) for _ in range(40)), "en"), (403, "the and of " * 9000, "en")]
    where = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, lang, "web", len(t or ""), "extra") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string")
    docs.coalesce(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def _rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, folder, tmp_path):
    docs, before = spark.read.parquet(f"{folder}/documents.parquet").select(corpus_pipeline.COLUMNS), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        out, before = spark.read.parquet(f"{tmp_path}/{name}"), docs
        have = _rows(before)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        got = _rows(out) if name != "packing" else out.collect()
        if name == "language":
            gone = {i for i, _ in have} - {i for i, _ in got}
            assert gone >= {400, 401, 402} and len(gone) <= 6
        elif name == "lines":
            distinct = {i: t for i, t in have if i is not None}
            want = {i: t for i, t in _brute_lines(sorted(distinct.items())).items() if t == distinct[i] or t.strip()}
            found = {i: t for i, t in got if i is not None}
            assert sum(want.get(i) != found.get(i) for i in set(want) | set(found)) <= 2
        elif name == "near_duplicates":
            sets = [minhash.shingle_set(t, 5) for _, t in have]
            parent = {k: k for k in range(len(have))}
            for a in range(len(have)):
                for b in range(a):
                    same = have[a] == have[b] or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
                    if same:
                        x, y = _root(parent, a), _root(parent, b)
                        parent[max(x, y)] = min(x, y)
            assert len(got) == len({_root(parent, k) for k in parent}) and set(got) <= set(have)
        elif name == "decontamination":
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
            clean = [(i, t) for i, t in have if not any(len(t) < 5000 and _edits(x, decontaminate.normal(t)) <= int(decontaminate.RATE * len(x)) for x in items)]
            assert sorted(got, key=str) == sorted(clean, key=str) and len(clean) < len(have)
        else:
            used = {}
            for r in got:
                used.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for own in used.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= packing.CAPACITY
            assert {r.doc_id for r in got} == {i for i, _ in have}
        docs = out


def test_near_duplicates_stage_on_nulls_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (None, text + " more"), (2, None), (2, None), (3, ""), (7, "an own text of a few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string")
    got = _rows(corpus_pipeline.dedup_documents(spark, docs, ""))
    assert len([t for _, t in got if t and t.startswith("w0")]) == 1
    assert sorted(t for _, t in got if t is not None and not t.startswith("w0")) == ["", "an own text of a few words"] and len(got) == 4


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert langid.Model([], __import__("numpy").zeros((0, langid.SPACE))).predict("text")[0] == langid.UND


def test_lines_stage_compares_whole_lines(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghi") for _ in range(n))
    heads = [word(12) for _ in range(20)]
    # The same behind each space, and different elsewhere: neither line goes.
    rows = [(i, "".join(f" {h}{word(30)}" for h in heads), "en", "web", 0) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()) == [0, 1]
