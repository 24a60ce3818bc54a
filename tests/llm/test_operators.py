"""The operators against brute force, on nulls, empty tables, ties and repeated rows."""

import base64
import gzip
import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moetrace.llm import ann, common, decontaminate, graph, langid, licenses, lines, minhash, packing, secrets, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _words(rng, n):
    return [rng.choice("alpha beta gamma delta omega sigma kappa theta lambda rho tau phi".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng, out = random.Random(1), []
    for i in range(60):
        w = _words(rng, rng.choice([0, 1, 5, 30, 80]))
        out.append((i, " ".join(w)))
        for k in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(1 + len(v) // 12)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(999)}"
            out.append((1000 + 10 * i + k, " ".join(v)))
    return [*out, (5000, None), (5001, ""), (5002, "  \n"), (0, out[0][1]), (None, out[3][1])]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def _root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(70)]
    parent = {x: x for p in links for x in p}
    for a, b in links:
        a, b = _root(parent, a), _root(parent, b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: _root(parent, x) for p in links if p[0] != p[1] for x in p}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, texts, size):
    got = minhash.near_duplicates(_docs(spark, texts), size).collect()
    assert len(got) == len(texts)
    sets = {i: minhash.shingle_set(t, size) for i, t in texts if i is not None}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = _root(parent, a), _root(parent, b)
                parent[max(x, y)] = min(x, y)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), _root(parent, r.doc_id), _root(parent, r.doc_id) == r.doc_id)


def test_large_mixed_buckets_are_not_compared_pair_by_pair(spark):
    """One bucket whose pivot is unlike the others, which are all alike."""
    n, asked = 150, []
    members = spark.range(n).selectExpr("7L as key", "id", "1 as copies")

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where("a > 0")

    prefixes = lambda ids: ids.select("id", F.lit(1).cast("long").alias("shingle"))
    found = graph.link_buckets(members, verify, lambda ids: ids.withColumn("n", F.lit(1)), "x_n = y_n", prefixes)
    parts = {r.node: r.component for r in found.collect()}
    assert {k: v for k, v in parts.items() if k} == dict.fromkeys(range(1, n), 1) and parts.get(0, 0) == 0
    assert sum(asked) < 4 * n


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog while the old grey cat sleeps under a large green tree by the river all day long and nobody in the small town nearby ever wonders why these two animals never meet before the first snow of winter falls"
    near = base.replace("grey", "gray")
    rows = [(1, f"{base}\n\nown line one here"), (2, f"{near}\nown line two there"), (3, base.upper()), (4, None), (5, ""), (6, "\n\n"), (3, base.upper())]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(_docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("own line two there", 1), 3: ("", 1), 4: (None, 0), 5: ("", 0), 6: ("\n\n", 0)}


def test_line_dedup_without_spaces(spark):
    rng = random.Random(6)
    cjk, code = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200)), "".join(rng.choice("0123456789abcdef") for _ in range(300))
    path = "://example.org/" + "".join(rng.choice("abcdefghij/_") for _ in range(200))
    near = [(cjk, "\u5b57" + cjk), ("https" + path, "http" + path), (code, code[:140] + code[141:]), (code[::-1], code[:140:-1] + "xy" + code[140::-1])]
    rows = [x for i, (a, b) in enumerate(near) for x in ((2 * i, a), (2 * i + 1, b))] + [(90, "tiny"), (91, "TINY"), (92, "tint"), (93, cjk[:120] + cjk[::-1])]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(_docs(spark, rows)).collect()}
    assert got == {**{i: i % 2 for i in range(8)}, 90: 0, 91: 1, 92: 0, 93: 0}


def test_sharding(spark, texts):
    got = sharding.shard_documents(_docs(spark, texts), 7).collect()
    assert len(got) == len(texts)
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(7)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(r.text_crc32 == zlib.crc32(dict(texts)[r.doc_id].encode()) for r in got if r.doc_id and dict(texts)[r.doc_id])
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.draw(rng, 30, 100, 20) for _ in range(4000)])
    assert abs(drawn.mean() - 6) < 0.15 and abs(drawn.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    m = sharding.matrix([10, 0, 25, 7], [14, 14, 14], 1)
    assert m.sum(axis=1).tolist() == [10, 0, 25, 7] and m.sum(axis=0).tolist() == [14, 14, 14]


def test_packing(spark, texts):
    rows = [*texts, (7000, "word " * 5000), (7001, "<|endoftext|> ́ é 你好")]
    got = packing.pack(_docs(spark, rows), VOCABULARY).collect()
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for doc_id, text in rows[-2:]:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc_id)
        assert sum(x[2] for x in mine) == len(ids) // 4 and all(x[2] == 2048 for x in mine[1:])
        assert all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for _, s, n, c in mine)


def test_plan_places_everything():
    rng = random.Random(5)
    counts = {n: rng.randrange(1, 200) for n in rng.sample(range(1, 2048), 300)}
    groups = packing.plan(counts)
    placed = {}
    for held, times in groups:
        assert sum(k * n for k, n in held.items()) <= 2048
        for k, n in held.items():
            placed[k] = placed.get(k, 0) + n * times
    assert placed == counts
    assert sum(t for _, t in groups) <= sum(t for _, t in packing.best_fit(counts, 2048))


def test_language(spark):
    rng = random.Random(1)
    make = lambda words: " ".join(rng.choice(words) for _ in range(30))
    kinds = {"aa": ["the", "and", "thing", "over"], "bb": ["der", "und", "schön", "ung"], "cc": ["los", "que", "ción", "para"]}
    rows = [(i, make(kinds[k]), k) for i, k in enumerate(list(kinds) * 20)] + [(900, None, None), (901, "12 34 !!", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, F.col("doc_id") % 4 != 2)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:60])
    assert got[900].lang_pred == got[901].lang_pred == "und"
    assert langid.predict(docs, langid.fit(docs, F.lit(False))).where("lang_pred <> 'und'").count() == 0


def test_decontamination(spark):
    rng = random.Random(4)
    items = [" ".join(_words(rng, 25)) for _ in range(8)] + ["short it"]
    bench = spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string")
    edited = list(items[1])
    for at in (20, 70, 110):
        edited[at] = "#"
    rows = [(1, "before " + items[0].upper() + " after"), (2, "".join(edited)), (3, items[2][: len(items[2]) // 2]), (4, None), (5, ""), (6, "x short it y"), (7, " ".join(_words(rng, 300)))]
    got = {r.doc_id: r["items"] for r in decontaminate.find_items(_docs(spark, rows), bench).collect()}
    assert got == {1: [0], 2: [1], 3: [], 4: [], 5: [], 6: [8], 7: []}


def test_secrets(spark):
    key = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    coded = base64.b64encode(gzip.compress(base64.b64encode(key.encode()))).decode()
    rows = [(1, key), (2, f"see {coded} there"), (3, None), (4, ""), (5, "password: short, AKIA123, abcdef0123"), (6, "AKIA" + "A" * 12)]
    got = {r.doc_id: ([tuple(x) for x in r.base], [tuple(x) for x in r.spans]) for r in secrets.find_secrets(_docs(spark, rows)).collect()}
    assert got[1][0] == [(0, 49, "assign"), (9, 49, "hex")]
    assert got[2][0] == [] and set(got[2][1]) == {(4, 4 + len(coded), "assign"), (4, 4 + len(coded), "hex")}
    assert got[3] == got[4] == got[5] == ([], []) and got[6][0] == [(0, 16, "access")]


def test_secrets_whole_layers():
    key, rng = b'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', random.Random(8)
    filler = " ".join(_words(rng, 90)).encode()
    kinds = lambda raw: {k for _, _, k in secrets.all_spans(raw if isinstance(raw, str) else base64.b64encode(raw).decode())}
    both = {"assign", "hex"}
    assert kinds(gzip.compress(filler) + gzip.compress(key)) == both  # a second member
    assert kinds(gzip.compress(filler) + b"\0\0" + key) == both  # behind the last member
    assert kinds("see\nMIME-Attachment-Of-Mail\n" + base64.encodebytes(gzip.compress(filler + key)).decode()) == both  # wrapped
    for pad in range(40):  # plain, the secret across a line break
        text = "data: " + base64.encodebytes(b"." * pad + b" " + key).decode()
        assert kinds(text) >= both and (6, len(text) - 1) in {(s, e) for s, e, _ in secrets.all_spans(text)}
    deep = key
    for _ in range(40):
        deep = gzip.compress(deep)
    assert kinds(deep) == both
    assert kinds(filler + b"\xff" + key) == both  # one byte that is not UTF-8
    assert kinds(b"x^" + key) == both  # no zlib stream, though it begins like one
    far = gzip.compress((b"\n." * 500 + b"\n") * 70_000 + base64.b64encode(gzip.compress(key)) + b" end")  # past 64 MB
    assert kinds(far) == both
    assert kinds(gzip.compress(filler)) == kinds(filler) == set()


def test_secrets_windows_lose_nothing(monkeypatch):
    rng, key = random.Random(3), b"AKIA" + b"A" * 16
    monkeypatch.setattr(secrets, "WINDOW", 256)
    monkeypatch.setattr(secrets, "OVERLAP", 64)
    monkeypatch.setattr(secrets, "CHUNK", 50)
    for _ in range(60):
        coded = rng.choice([key, base64.b64encode(rng.randbytes(300) + b" " + key), base64.encodebytes(rng.randbytes(300) + b" " + key)])
        text = b" ".join(rng.choice([b"word,", "n\u00e4chste".encode(), b"x" * 40]) for _ in range(rng.randrange(200))) + b" , " + coded + b" , " + b"tail, " * rng.randrange(90)
        assert {k for _, _, k in secrets.all_spans(base64.b64encode(gzip.compress(text)).decode())} == {"access"}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 16))
    v[7] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (2004, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(df, F.expr("vec_id % 50 = 0")).collect()}
    unit, found = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    for q in range(0, 1200, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(1200), -s))[:5]
        found += len({got[q, r][0] for r in range(1, 6)} & set(best))
    assert found / (24 * 5) >= 0.9 and got[50, 1][0] == 7 and abs(got[50, 1][1] - 1) < 1e-12
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_toxicity(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(_words(rng, 20) + (["nastyword"] if i % 3 == 0 else []))) for i in range(300)]
    docs = _docs(spark, [*rows, (900, "such a n4styw0rd here"), (901, None), (902, "")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(300))
    assert got[900] >= 0.5 > got[901] == got[902]


def test_licenses(spark):
    rows = [(1, "some lines of code that say nothing else\nReleased under the MIT license\nmore of the same kind"), (2, None), (3, ""), (4, licenses.TEMPLATES["ISC-grant"].upper()), (5, "license")]
    got = {(r.doc_id, r.line, r.license) for r in licenses.scan(_docs(spark, rows)).collect()}
    assert got == {(1, 1, "MIT-notice"), (4, 0, "ISC-grant")}


def test_licenses_in_windows(spark):
    code = "".join(f"int main{i}() {{\n  return run{i}(first{i}, second{i});\n}}\n" for i in range(40))
    wrap = lambda name: "\n".join(" * " + x for x in textwrap.wrap(licenses.TEMPLATES[name], 60))
    twice = f"/*\n{wrap('MIT-grant')}\n*/\n{code}/*\n{wrap('MIT-grant')}\n*/"
    rows = [(1, f"/*\n{wrap('Apache-2.0-header')}\n */\n{code}"), (2, code + wrap("GPL-3.0-header")), (3, twice), (4, "this whole page of notes about many things was once released under the MIT License by people who wrote it"), (5, code), (6, code + "Released under the MIT License.\n" + code)]
    got = {(r.doc_id, r.line, r.license, r.dice) for r in licenses.scan(_docs(spark, rows)).collect()}
    assert {x for x in got if x[2] != "Apache-2.0-notice"} == {(1, 1, "Apache-2.0-header", 1.0), (2, 120, "GPL-3.0-header", 1.0), (3, 1, "MIT-grant", 1.0), (3, twice.count("\n", 0, twice.rindex("/*")) + 1, "MIT-grant", 1.0), (4, 0, "MIT-notice", 1.0), (6, 120, "MIT-notice", 1.0)}


def test_empty_tables(spark):
    none = _docs(spark, [])
    assert minhash.near_duplicates(none).count() == lines.dedup_lines(none).count() == sharding.shard_documents(none).count() == 0
    assert packing.pack(none, VOCABULARY).count() == secrets.find_secrets(none).count() == licenses.scan(none).count() == 0


def test_settling_gives_the_drivers_heap_back(spark):
    """By itself the JVM keeps 70 % of its heap free after a collection."""
    jvm = spark.sparkContext._jvm
    large = [jvm.java.nio.ByteBuffer.allocate(1 << 20) for _ in range(300)]
    del large
    common.settle(spark.range(3))
    heap = jvm.java.lang.Runtime.getRuntime()
    assert heap.freeMemory() <= 0.6 * heap.totalMemory()
