"""The operators against brute force: edits, pairs of lines, paths of a lattice, ids, and held-out rows."""

import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moetrace.llm import ann, decontaminate, graph, langid, lines, minhash, packing, queries, secrets, sharding, toxicity

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def _root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# Lines


def _line_set(line):
    low = line.lower()
    return {low[i : i + 12] for i in range(len(low) - 11)} if len(low) >= 12 else {low}


def _near_lines(a, b):
    x, y = _line_set(a), _line_set(b)
    return 100 * len(x & y) >= lines.PERCENT * len(x | y)


def _brute_lines(rows):
    """The texts that line dedup leaves, over all pairs of lines."""
    places = sorted((i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if line.strip())
    distinct = sorted({x[2].lower() for x in places})
    parent = {x: x for x in distinct}
    for a, b in itertools.combinations(distinct, 2):
        if _near_lines(a, b):
            x, y = _root(parent, a), _root(parent, b)
            parent[max(x, y)] = min(x, y)
    first = {}
    for i, k, line in places:
        first.setdefault(_root(parent, line.lower()), (i, k))
    kept = set(first.values())
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or (i, k) in kept) for i, t in rows}


def _line_rows(seed, n):
    rng, rows = random.Random(seed), []
    alphabets = ["abcdefghijklmnoprstuvwy ", "abcdefghi0123456789", "".join(chr(0x4E00 + 7 * i) for i in range(400)), "aeiourstlmn   .,"]
    base = ["".join(rng.choice(alphabets[i % 4]) for _ in range(rng.choice([5, 30, 120, 300]))) for i in range(30)]
    for i in range(n):
        own = []
        for _ in range(rng.randrange(5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice("#kq")
            own.append("".join(line) if rng.random() < 0.9 else "  \t")
        rows.append((i, "\n".join(own)))
    return [*rows, (n, None), (n + 1, "")]


def test_lines_against_all_pairs(spark):
    rows = _line_rows(1, 60)
    want = _brute_lines(rows)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    # Signatures may miss a pair near 0.8: all but a few lines are the same.
    wrong = [i for i in want if want[i] != got[i]]
    assert len(wrong) <= 2, wrong


def test_lines_are_compared_at_all_positions(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghi") for _ in range(n))
    heads = [word(12) for _ in range(20)]
    # The same behind each space, and different elsewhere.
    apart = ["".join(f" {h}{word(30)}" for h in heads) for _ in range(2)]
    # Different behind five of twenty spaces, and the same elsewhere.
    whole = [f" {word(42)}" for _ in range(20)]
    close = ["".join(whole), "".join(f" m{w[2:]}" if i < 5 else w for i, w in enumerate(whole))]
    assert not _near_lines(*apart) and _near_lines(*close)
    rows = list(enumerate([*apart, *close]))
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1}


def test_lines_just_near_enough_are_found(spark):
    """Pairs just above the bound: keys of few hashes of a line lose some of them. Repeated shingles leave sectors empty."""
    rng, rows = random.Random(12), []
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for i in range(400):
        n = rng.choice([150, 250, 600])
        line = word("abcdefghijklmnoprstuvwxyz ", n + 11)
        rows += [(2 * i, line), (2 * i + 1, line + word("0123456789", n // 4))]
    assert all(_near_lines(rows[k][1], rows[k + 1][1]) for k in range(0, 800, 2))
    rows += [(800, "ab" * 900), (801, "ab" * 901), (802, "x" * 700), (803, "yz" + "x" * 700)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in got if got[i] != (i % 2 if i < 802 else 0)] == []


def _family(seed, n, length, edits):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefghijklmnoprstuvwy ") for _ in range(length))
    out = []
    for _ in range(n):
        line = list(base)
        for _ in range(rng.choice(edits)):
            line[rng.randrange(length)] = rng.choice("0123456789")
        out.append("".join(line))
    return out


def test_long_lines_of_large_buckets_meet_by_few_shingles(spark, monkeypatch):
    """Each pair comes from its first common shingle, which is known where a line has few of them."""
    own, seen = _family(3, 40, 1500, [2, 5, 8]), {}

    def link(members, verify, info, near, prefixes, *closer):
        ids = members.select("id").distinct()
        pairs = ids.withColumnRenamed("id", "a").crossJoin(ids.withColumnRenamed("id", "b")).where("a < b")
        seen["links"] = [tuple(r) for r in verify(pairs).collect()]
        seen["first"] = [tuple(r) for r in prefixes(ids).collect()]
        return graph.components(pairs.limit(0))

    monkeypatch.setattr(lines, "link_buckets", link)
    lines.dedup_lines(spark.createDataFrame(list(enumerate(own)), SCHEMA)).count()
    by = {}
    for i, shingle in seen["first"]:
        by.setdefault(i, set()).add(shingle)
    assert len(seen["links"]) == sum(_near_lines(a, b) for a, b in itertools.combinations(own, 2)) > 20
    assert max(map(len, by.values())) <= graph.SHORT and all(by[a] & by[b] for a, b in seen["links"])


def test_shingles_of_lines_are_hashed_once(spark, monkeypatch):
    """In signing the condition on hashes makes none a second time; a line's set is made once for all pairs it is the first
    end of, and sets are intersected in generated code, not in a lambda; prefixes are ranked without lists."""
    plan, seen = lambda df: df._jdf.queryExecution().optimizedPlan().toString(), {}
    own = _family(5, 12, 300, [1, 2, 30])
    assert plan(lines._nearest(spark.createDataFrame(list(enumerate(own)), "_id long, _line string"), 112)).count("xxhash64(") == 1

    def link(members, verify, info, near, prefixes, *closer):
        ids = members.select("id").distinct()
        links = verify(ids.withColumnRenamed("id", "a").crossJoin(ids.withColumnRenamed("id", "b")).where("a < b"))
        seen["links"], seen["plan"] = links.count(), plan(links)
        first = []
        monkeypatch.setattr(lines, "settle", lambda df, settle=lines.settle: first.append(plan(df)) or settle(df))
        prefixes(ids)
        seen["prefixes"] = "".join(first)
        return graph.components(links.limit(0))

    monkeypatch.setattr(lines, "link_buckets", link)
    lines.dedup_lines(spark.createDataFrame(list(enumerate(own)), SCHEMA)).count()
    assert seen["links"] == sum(_near_lines(a, b) for a, b in itertools.combinations(own, 2)) > 10
    assert re.search(r"array_intersect\(x#\d+, y#\d+\)", seen["plan"]) and "collect_list" not in seen["prefixes"]


def test_keys_of_two_members_are_not_read_again(spark):
    """The ids of a key's rows tell its members, where it has two; copies of lines are counted while they are signed."""
    rows = [(1, 10, 1), (1, 11, 1), (2, 11, 1), (2, 10, 1), (3, 10, 1), (3, 12, 1), (3, 13, 2), (4, 14, 1), (5, 15, 1), (5, 15, 1), (6, 16, 1), (6, 17, 1), (6, 17, 1)]
    two, crowd = graph.crowded(spark.createDataFrame(rows, "key long, id long, copies int"))
    assert [tuple(r) for r in two.collect()] == [(10, 11)]
    assert sorted(tuple(r) for r in crowd.select("key", "id", "pivot", "many").collect()) == [(3, 10, 13, 3), (3, 12, 13, 3), (3, 13, 13, 3), (6, 16, 17, 2), (6, 17, 17, 2)]
    own = [(1, "the same line of some length, twice"), (1, "the same line of some length, twice"), (2, "short")]
    assert {r._id: r.copies for r in lines._nearest(spark.createDataFrame(own, "_id long, _line string"), 112).collect()} == {1: 2, 2: 1}


def test_lines_that_cannot_link_are_not_compared_by_their_sets(spark, monkeypatch):
    rng, counts = random.Random(7), []
    head = "the same words stand here before all that comes after them in each of these lines "
    rows = [(i, head + "".join(rng.choice("abcdefghi") for _ in range(200))) for i in range(60)] + [(60 + i, x) for i, x in enumerate(_family(8, 6, 400, [1, 2]))]

    def settled(df, settle=lines.settle):
        out = settle(df)
        if out.columns == ["a", "b"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(lines, "settle", settled)
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: int(i > 60) for i in range(66)}
    assert counts[0] > 20 and sum(counts[1:]) <= 15


def test_texts_and_signatures_leave_the_disk_before_lines_are_linked(spark, monkeypatch):
    made, left, folders = [], [], {}

    def settled(df, settle=lines.settle):
        made.append(settle(df))
        folders[id(made[-1])] = made[-1].inputFiles()
        return made[-1]

    def components(links, components=graph.components):
        for df in made:
            if ("m0" in df.columns or {"_pos", "_line"} <= {*df.columns}) and any(Path(f.removeprefix("file:")).exists() for f in folders[id(df)]):
                left.append(df.columns)
        return components(links)

    monkeypatch.setattr(lines, "settle", settled)
    monkeypatch.setattr(graph, "components", components)
    rows = [*enumerate(_family(9, 5, 200, [1])), (9, "\t \x0b\f\r\n\x1f\n\u3000")]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: int(0 < i < 9) for i, _ in rows}
    assert any("m0" in df.columns for df in made) and left == []


def test_lines_with_clashing_columns(spark):
    rows = [(1, "one line here\none line here", 7, "a", "b"), (2, None, 8, "c", "d")]
    got = lines.dedup_lines(spark.createDataFrame(rows, SCHEMA + ", gone long, n_removed string, kept string"))
    assert sorted(got.columns) == ["doc_id", "gone", "kept", "n_lines", "n_removed", "text"]
    assert [(r.text, r.gone, r.n_removed) for r in got.orderBy("doc_id").collect()] == [("one line here", 7, 1), (None, 8, 0)]


# Ids that pandas would round


def test_long_ids_beside_nulls(spark):
    ids = [2**60 + 1, 2**60 + 3, None]
    docs = spark.createDataFrame([(i, f"some own words number {k} that no other row has {k * k}") for k, i in enumerate(ids)], SCHEMA).coalesce(1)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got[ids[0]] == ids[0] and got[ids[1]] == ids[1] and set(got) == set(ids)
    assert {r.doc_id for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()} == set(ids)


# Packing


def test_ids_are_the_tokenizers(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), packing._Ids(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text is not None]
    texts += ["".join(map(chr, range(i, min(i + 997, 0xD800)))) for i in range(0, 0xD800, 997)]
    texts += ["a" + "".join(map(chr, range(i, i + 4096))) + " b" for i in range(0xE000, 0x30000, 4096)]
    texts += ["x\r\n\t y  z  w", "don't we'll 123abc ___", "<|endoftext|>x", "😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    for t in texts:
        assert own.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t[:40])


def test_programme_beats_best_fit_where_it_can():
    rng = random.Random(5)
    counts = {}
    for _ in range(20_000):
        n = rng.randrange(500, 900)
        counts[n] = counts.get(n, 0) + 1
    groups, report = packing.solve(counts)
    placed = {}
    for held, times in groups:
        assert sum(k * n for k, n in held.items()) <= packing.CAPACITY
        for k, n in held.items():
            placed[k] = placed.get(k, 0) + n * times
    assert placed == counts and report["share"] > 0.5
    assert report["bound"] <= report["sequences"] < 0.95 * report["best_fit"]
    assert packing.solve({})[0] == [] and packing.solve({2048: 3})[1]["sequences"] == 3


# Decontamination


def _edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def _edited(rng, item, n):
    x = list(item)
    for _ in range(n):
        at, kind = rng.randrange(len(x)), rng.randrange(3)
        x[at : at + 1] = [["#"], [], [x[at], "~"]][kind]
    return "".join(x)


def test_items_against_edit_distances():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 6)))
    items = [" ".join(word() for _ in range(60))[: rng.choice([4, 6, 9, 12, 13, 17, 25, 28, 38, 50, 90, 200])].strip() for _ in range(60)]
    index = decontaminate.Index(list(enumerate(items)))
    seen = 0
    for _ in range(150):
        k = rng.randrange(len(items))
        most = int(decontaminate.RATE * len(items[k]))
        parts = [" ".join(word() for _ in range(rng.randrange(12))), _edited(rng, items[k], rng.randrange(most + 2)), " ".join(word() for _ in range(rng.randrange(12)))]
        text = decontaminate.normal(rng.choice([" ", ""]).join(parts))
        want = [i for i, item in enumerate(items) if _edits(item, text) <= int(decontaminate.RATE * len(item))]
        assert index.find(text) == want
        seen += len(want)
    assert seen > 100


def test_short_items_with_edits():
    for n in (17, 28, 38):
        item = "".join(random.Random(n).choice("abcdefghijklmnop") for _ in range(n))
        for at in range(n):
            assert decontaminate.Index([(1, item)]).find("xx " + item[:at] + "#" + item[at + 1 :] + " yy") == [1]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)
    bench = spark.createDataFrame([(i, f"a benchmark question of number {i * 7919}") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x a benchmark question of number {i * 7919} y", "z") for i in range(5)], SCHEMA + ", items string")
    got = decontaminate.find_items(docs, bench)
    assert got.columns.count("items") == 1 and all(r.doc_id in r["items"] for r in got.collect())
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0 and decontaminate.find_items(docs, bench.limit(0)).where("size(items) > 0").count() == 0


# Toxicity


def test_lattice_against_all_paths():
    rng = np.random.default_rng(2)
    decoder = toxicity.Decoder(rng.integers(0, 50, (toxicity.K,) * 3).astype(float))

    def cost(token, choice):
        s, a, b = 0.0, 0, 0
        for x, c in choice:
            s -= c
            if x:
                k = toxicity.CODE.get(x, toxicity.K - 1)
                s, a, b = s + float(decoder.log[a, b, k]), b, k
        return s + float(decoder.log[a, b, 0])

    for token in ("n4st!", "b.a.d", "aaab", "1l0v3", "x", "h3ll0o", "$|!"):
        steps = []
        for i, c in enumerate(token):
            if c.isalpha():
                own = [(c, 0.0)]
                if i and token[i - 1] == c:
                    run = (i > 1 and token[i - 2] == c) or token[i + 1 : i + 2] == c
                    own.append(("", toxicity.DROP_REPEAT if run else toxicity.DROP_DOUBLE))
            else:
                own = [(x, toxicity.AS_LETTER) for x in toxicity.LEET.get(c, "")]
                own.append(("", toxicity.DROP if c in toxicity.SEPARATORS else toxicity.DROP_DIGIT if c.isdigit() else toxicity.DROP_SYMBOL))
            steps.append(own)
        best = max(itertools.product(*steps), key=lambda p: cost(token, p))
        word = decoder.restore(token)
        assert abs(max(cost(token, p) for p in itertools.product(*steps) if "".join(x for x, _ in p) == word) - cost(token, best)) < 1e-4
    assert len(decoder.restore("a!" * 20_000)) <= 40_000


def _accuracy(rows, at):
    return sum(map(at, rows)) / len(rows)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").select("doc_id", "lang").collect())
    out = [r for r in queries.op5_langid(spark, sf).collect() if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(out) > 100 and _accuracy(out, lambda r: r.lang_pred == lang[r.doc_id]) > 0.97
    toxic = dict(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").select("doc_id", "toxic").collect())
    out = [r for r in queries.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert len(out) > 30 and _accuracy(out, lambda r: r.predicted == toxic[r.doc_id]) > 0.93


def test_classifiers_on_empty_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA + ", lang string")
    assert langid.predict(none, langid.fit(none, F.lit(True))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    rows = [(i, "der die das und", "de") for i in range(50)] + [(99, "the and of to", "en"), (100, "", "en"), (101, None, "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], SCHEMA + ", lang string, score double")
    said = langid.predict(docs, langid.fit(docs, F.lit(True)))
    assert said.columns.count("score") == 1 and {r.doc_id: r.lang_pred for r in said.collect()}[3] == "de"
    twice = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (99, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, twice)).where("score between 0 and 1").count() == len(rows)


# Secrets


def test_secrets_behind_other_letters():
    import base64

    key = b'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    for lead in ("a/", "ab", "x+9", "path/to/"):
        assert {k for _, _, k in secrets.all_spans("see " + lead + base64.b64encode(key).decode())} >= {"hex"}
    assert {k for _, _, k in secrets.all_spans("%74oken%3D%22abcd%65fgh%22 \\u0041KIA" + "A" * 12)} >= {"assign", "access"}


def test_repeated_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "password=abcdefgh1", "x", 1)] * 2, SCHEMA + ", spans string, size int")
    found = secrets.find_secrets(docs)
    assert found.columns.count("spans") == 1 and [len(r.spans) for r in found.collect()] == [1, 1]
    assert sorted(r.slot for r in sharding.shard_documents(docs, 1).collect()) == [0, 1]


def test_shards_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * (i % 50) if i % 7 else None, i) for i in range(300)], SCHEMA + ", size int")
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(back) == 300 and all(r.size == len(r.text or "") + 8 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in back)
    assert all(sorted(r.slot for r in back if r.shard == s) == list(range(60)) for s in range(5))


def test_neighbours_with_many_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKED", 20)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.expr("vec_id % 4 = 0")).collect()
    assert len(got) == 500 and len({(r.query_id, r.rank) for r in got}) == 500
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = {q: set(np.argsort(-np.where(np.arange(400) == q, -2, unit @ unit[q]), kind="stable")[:5]) for q in range(0, 400, 4)}
    assert sum(r.vec_id in best[r.query_id] for r in got) / 500 >= 0.9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matrix_is_exact(seed):
    rng = random.Random(seed)
    rows = [rng.randrange(2000) for _ in range(9)]
    total = sum(rows)
    columns = [total // 7 + (i < total % 7) for i in range(7)]
    m = sharding.matrix(rows, columns, seed)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == columns and (m >= 0).all()
