"""Near-duplicates, substring dedup, token files, compaction, mixing, the pipeline: brute force, round trips, odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import compaction, graph, mixing, near_dedup, substring_dedup, token_files
from parcelflow.llm.grouping import suffix_array
from parcelflow.llm.queries import ORACLES, QUERIES
from tests.llm.test_text_operators import docs, words
from tests.oracle import connection, same


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(n, rng, base=60):
    out = {}
    heads = [[f"{rng.randrange(10**6)}" for _ in range(base)] for _ in range(6)]
    for i in range(n):
        w = list(heads[i % 6] if i % 3 else [f"{rng.randrange(10**6)}" for _ in range(base)])
        for _ in range(rng.randrange(3)):
            w[rng.randrange(base)] = str(rng.randrange(10**6))
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("small, block", [(48, 256), (4, 8)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup.linked, "__defaults__", (block,))
    texts = copies(120, random.Random(small))
    texts |= {200: "", 201: "", 202: None, 203: "one two", 204: "One  TWO", 205: texts[1], 206: "  "}
    rows = docs(spark, *texts.values(), ids=list(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(rows).collect()}
    assert {i: g[:2] for i, g in got.items()} == brute_groups(texts)
    assert all(g[2] == (g[1] == i) for i, g in got.items())


def test_near_duplicates_odd_rows(spark):
    same_text = "a b c d e f g h"
    rows = docs(spark, same_text, same_text, same_text, "x y z", ids=[None, 4, 4, 9])
    got = [tuple(r) for r in near_dedup.near_duplicates(rows).collect()]
    assert sorted(got, key=str) == sorted([(None, 4, None, True), (4, 4, 4, True), (4, 4, 4, True), (9, 1, 9, True)], key=str)
    left = near_dedup.one_of_each(rows)
    assert left.columns == rows.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["4", "9", "None"]
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_suffix_array_by_grouping():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_removal(texts, length):
    seen = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            seen.setdefault(t[k : k + length], []).append(i)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if len(seen[t[k : k + length]]) > 1:
                gone[k : k + length] = [True] * length
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


def test_the_suffix_order_decides_which_strings_are_compared(monkeypatch):
    """Contexts share a number while their blocks are equal; without that their strings would count as equal."""
    rng = random.Random(6)
    word = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    anchor, left, right, end = word(40), word(90), word(100), word(60)
    data = [left + anchor + right + end, left + anchor + right[:50] + word(50) + end, word(90) + anchor + right + end, left + anchor + right[:59]]
    offset = np.array([90] * 4)
    groups = substring_dedup.by_suffixes(data, offset, 10)
    for depth in range(11):
        for i, j in ((0, 1), (0, 2), (1, 2)):
            assert (groups[depth, i] == groups[depth, j]) == (data[i][90 : 90 + 20 * depth] == data[j][90 : 90 + 20 * depth])
    n = np.array([len(d) - 199 if len(d) >= 200 else 0 for d in data])
    n = np.minimum(n, 91)
    strings = {(i, k): d[k : k + 200] for i, d in enumerate(data) for k in range(n[i])}
    twice = {key for key, s in strings.items() if list(strings.values()).count(s) > 1}
    found = lambda: {(i, k) for i, a, b in substring_dedup.repeated_in(data, offset, n, 200) for k in range(a, b)}
    assert twice and found() == twice
    monkeypatch.setattr(substring_dedup, "by_suffixes", lambda data, offset, depth: np.zeros((depth + 1, len(data)), np.int64))
    assert found() > twice


@pytest.mark.parametrize("most", [2000, 2])
def test_substring_dedup_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST", most)
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(6))
    passages = [" ".join(word() for _ in range(n)) for n in (10, 20, 30, 45, 60, 90)]
    texts = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), " ".join(word() for _ in range(rng.randrange(10)))]
        texts.append("".join(parts))
    texts += ["", "ab" * 300, "z" * 500, texts[3], texts[3], "x" * 199]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeated(docs(spark, *texts, None)).collect()]
    assert sorted(got) == brute_removal([(i, t.encode()) for i, t in enumerate([*texts, ""])], 200)


def test_substring_dedup_of_long_texts_in_parts(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(420))
    filler = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    texts = {1: filler(1500) + passage + filler(900), 2: passage[:350] + filler(2500), 3: filler(690) + passage + filler(10), 4: filler(3000)}
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated(docs(spark, *texts.values(), ids=list(texts)), part=700).collect()}
    kept = {1: texts[1].replace(passage, ""), 2: texts[2][350:], 3: texts[3].replace(passage, ""), 4: texts[4]}
    assert got == {i: (len(texts[i]) - len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept.items()}


def test_substring_dedup_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = docs(spark, t, t, t, ids=[None, 1, 1])
    assert [r["n_removed"] for r in substring_dedup.remove_repeated(rows).collect()] == [len(t)] * 3
    assert substring_dedup.remove_repeated(rows.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encode():
    library = token_files.Encoder(token_files.default_vocabulary())
    return library


@pytest.mark.parametrize("text", ["", " ", "a", "Two words, here.\nNext line", " lead", "trail ", "a  b", "a\n\nb", "a \nb", "tab\tx y", "<|endoftext|> a b", "été naïve 中文 字 \u00a0x", "12 345 6.7 !!", "x\u2028y z", "a" * 3000 + " b", "\u00d7a \u00f7.b \u0250. \u01c0-x", "it's we'll\u2019s \u2026...", "a\x1cb \x00 c", "lepa\u00e9, x,### 9a 12ab"])
def test_pieces_encode_like_whole_texts(encode, text):
    assert encode.encode([text]) == encode.whole([text])
    assert encode.encode([text, "z " + text]) == encode.whole([text, "z " + text])


def test_pieces_of_random_texts(encode, monkeypatch):
    monkeypatch.setattr(encode, "KEPT", 500)
    monkeypatch.setattr(encode, "STEP", 7)
    rng = random.Random(3)
    signs = ["a", "B", "\u00e9", "\u00d7", "\u01c3", "\u0250", "\u2026", "1", "\u0663", " ", "\n", "\t", ".", "'", "'s", "-", "<", "\u4e2d", "\u00a0", "\x85", "\u2003", "\x00", "\x1c", "\u00aa", "\U0001f600", "\u0301", "\r"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert encode.encode(texts) == encode.whole(texts)


def test_token_files_round_trip(spark, encode, sf_dir):
    texts = ["b c d", "", None, "é 中 " * 9000, "same", "same"]
    ids = [30, 2, 11, 4, 7, 7]
    from parcelflow.llm.common import new_dir

    path = new_dir(spark, "test-tokens")
    manifest = token_files.write_token_files(docs(spark, *texts, ids=ids), path, docs_per_file=2)
    rows = sorted(zip(ids, texts), key=lambda r: r[0])
    want, start = [], 0
    for i, t in rows:
        raw = encode.whole([t or ""])[0]
        want.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    got = sorted(map(tuple, token_files.read_token_files(spark, manifest).collect()))
    assert got == sorted(want)
    assert manifest.agg(F.sum("n_tokens")).first()[0] == start
    name = manifest.orderBy("shard", "piece").first()["path"]
    reader = token_files.Reader(name)
    assert reader.doc_ids[0] == 2 and reader.tokens(0).tolist() == [2]
    assert token_files.token_documents(docs(spark).limit(0)).count() == 0
    real = name.removeprefix("file://")
    raw = bytearray(open(real, "rb").read())
    raw[2] ^= 255
    open(real, "wb").write(raw)
    with pytest.raises(Exception):
        token_files.Reader(name).frame(0)


def test_seek_table_is_the_public_format():
    raw = token_files.seek_table([(10, 20, 30)])
    assert raw == bytes.fromhex("5e2a4d18 15000000 0a000000 14000000 1e000000 01000000 80 b1ea928f".replace(" ", ""))


def test_compaction(spark, tmp_path):
    df = docs(spark, *[f"text {i}" for i in range(40)], None, ids=[*range(40), None]).withColumn("arrival", F.col("doc_id") % 9)
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s", df.drop("arrival").schema)
    assert store.read().count() == 0 and store.append(df, "arrival") == 1
    assert len(store.runs()) == 10
    last = store.compact(target=1 << 20, fanout=4)
    assert last > 1 and len(store.runs()) < 4 and store.read().count() == 41 and store.read(1).count() == 41
    store.append(df.drop("arrival").limit(3))
    assert store.read().count() == 44
    with pytest.raises(compaction.Conflict):
        store.commit([], 1)
    store.vacuum(keep=1)
    assert store.read().count() == 44
    # what a failed append or merge has left goes, what is listed stays
    df.drop("arrival").limit(2).write.parquet(f"file://{tmp_path}/s/run-left")
    listed = {r["path"].split("/")[0] for r in store.runs()}
    store.vacuum(keep=1, older_than_s=3600)
    assert (tmp_path / "s/run-left").exists()
    store.vacuum(keep=1)
    assert {x.name for x in (tmp_path / "s").iterdir() if x.name.startswith("run-")} == listed and store.read().count() == 44
    assert compaction.compacted(df.limit(0), "arrival").count() == 0


def test_compaction_merges_runs_of_like_size(spark, tmp_path):
    rows = docs(spark, *["word " * (40 + i) for i in range(64)], ids=range(64)).withColumn("_arrival", F.lit(3)).withColumn("day", F.col("doc_id") % 16)
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s", rows.drop("day").schema)
    store.append(rows, "day")
    before = store.runs()
    last = store.compact(target=1 << 20, fanout=4, base=1 << 14)
    tiers = [store.tier(r["bytes"], 1 << 14, 4) for r in store.runs()]
    assert len(before) == 16 and last == store.version() > 1 and all(tiers.count(t) < 4 for t in tiers) and sum(r["files"] for r in store.runs()) < 16
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.drop("day").collect())) and store.read(1).count() == 64


def test_raking_meets_its_margins():
    rng = np.random.default_rng(0)
    cells = [(s, g, t, int(rng.integers(50, 500))) for s in "abc" for g in "xy" for t in "pq"]
    given = {"source": {"a": 0.4, "b": 0.4, "c": 0.2}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.6, "q": 0.4}}
    p = mixing.rake(cells, given, {}, share=0.05)
    w = p * [c[3] for c in cells]
    for m, name in enumerate(mixing.MARGINS):
        for k, goal in given[name].items():
            assert abs(sum(x for x, c in zip(w, cells) if c[m] == k) / w.sum() - goal) < 1e-6
    assert abs(w.sum() / sum(c[3] for c in cells) - 0.05) < 1e-9


def test_raking_on_executors_is_the_same(spark):
    rng = np.random.default_rng(1)
    cells = sorted((s, g, t, int(rng.integers(50, 500))) for s in "ab" for g in "xy" for t in "pq")
    p = mixing.rake(cells, {}, mixing.TEMPER, rounds=3)
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    got = {tuple(r)[:3]: r["p"] for r in mixing.rake_table(df, {}, mixing.TEMPER, rounds=3).collect()}
    assert np.allclose([got[c[:3]] for c in cells], p)


def test_mixing_odd_rows(spark):
    rows = docs(spark, "a b c", "", None, "d e", "f g", ids=[1, 2, 3, None, 4]).withColumn("topic", F.lit(1)).withColumn("p", F.lit("x")).withColumn("source", F.when(F.col("doc_id") == 4, F.lit(None)).otherwise("s"))
    got = mixing.mix(rows, share=1.0, temper={}).collect()
    assert {(r["doc_id"], r["source"], r["topic"], r["tokens"], r["p"]) for r in got} == {(1, "s", "note", 3, 1.0), (4, None, "note", 2, 1.0)} and mixing.mix(rows.limit(0)).count() == 0
    for name in ("_source", "_Lang", "_topic", "tokens", "_p"):
        rows = rows.withColumn(name, F.lit(7))
    kept = mixing.sample(rows.unionByName(rows.where("doc_id = 1")), share=1.0, temper={})
    assert kept.columns == rows.columns and [tuple(r) for r in kept.orderBy("doc_id").collect()] == [tuple(r) for r in rows.unionByName(rows.where("doc_id = 1")).where("doc_id in (1, 4)").orderBy("doc_id").collect()]
    assert mixing.sample(rows.limit(0)).count() == 0


def test_mixing_reports_what_it_misses(spark):
    cells = spark.createDataFrame([("a", "x", "p", 900), ("b", "x", "p", 100)], "source string, lang string, topic string, tokens long")
    met = {r["value"]: r["off"] for r in mixing.report(mixing.probabilities(cells, {"source": {"a": 0.5, "b": 0.5}}, {}, mixing.MARGINS, 0.1), {"source": {"a": 0.5, "b": 0.5}}, {}).where("margin = 'source'").collect()}
    assert max(met.values()) < 1e-9
    # b has not the tokens for half of the sample, c has none at all
    given = {"source": {"a": 0.4, "b": 0.4, "c": 0.2}}
    short = {r["value"]: r["off"] for r in mixing.report(mixing.probabilities(cells, given, {}, mixing.MARGINS, 0.5), given, {}).where("margin = 'source'").collect()}
    assert short["b"] > 0.1 and round(short["c"], 6) == 0.2


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, sf_dir, name):
    same(spark, connection(sf_dir), sf_dir, QUERIES[name], ORACLES[name])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    from parcelflow.llm import template_decontamination
    from parcelflow.llm.common import table, written

    docs_now = table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs_now, sf_dir), f"test-{name}")
        seen[name] = (docs_now, out)
        if name != "tokens":
            assert out.columns == docs_now.columns and out.join(docs_now, docs_now.columns, "left_anti").count() == 0
        docs_now = out
    before, after = seen["near_duplicates"]
    groups = brute_groups({r["doc_id"]: r["text"] for r in before.collect()})
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in groups.items() if i == c}
    before, after = seen["benchmark_leaks"]
    leaks = {r["doc_id"] for r in template_decontamination.contaminated(before, table(spark, sf_dir, "benchmark")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - leaks
    before, after = seen["mixing"]
    cells, rows = {}, [r for r in before.collect() if re.search(r"[^\x20\x09-\x0D]", r["text"] or "")]
    for r in rows:
        x = r["text"]
        t = "table" if " | " in x else "shout" if "!!" in x else "markup" if "###" in x or "%%%" in x else "note" if len(x) < 600 else "prose"
        cells.setdefault((r["source"], r["lang"], t), []).append((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", x))))
    keys = sorted(cells)
    p = mixing.rake([(*k, sum(n for _, n in cells[k])) for k in keys], {}, mixing.TEMPER)
    want = {i for k, x in zip(keys, p) for i, _ in cells[k] if int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < x}
    assert {r["doc_id"] for r in after.collect()} == want
    before, after = seen["tokens"]
    assert after.count() == before.count() > 0


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    import corpus_pipeline

    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = {"_source": 1, "p": "x", "topic": "t", "tokens": 2.5, "shard": 4, "doc": "d", "label": 3, "size": 9, "_rank": 0}
    odd = base.where("doc_id < 40").unionByName(base.where("doc_id < 5"))
    odd = odd.unionByName(odd.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema))).unionByName(odd.where("doc_id = 7").withColumn("text", F.lit("")).withColumn("source", F.lit(None).cast("string")))
    for name, value in clash.items():
        odd = odd.withColumn(name, F.lit(value))
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            if name != "tokens":
                assert out.columns == rows.columns and out.exceptAll(rows).count() == 0, name
            else:
                assert out.count() == rows.count()
            if not rows.isEmpty() and name in ("near_duplicates", "benchmark_leaks"):
                assert out.where("doc_id is null").count() == 3, name


def test_one_of_each_takes_the_least_text(spark):
    rows = docs(spark, "b b b", "a a a", "c", "a a a", ids=[1, 1, 2, 1])
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.one_of_each(rows).collect()) == [(1, "a a a"), (2, "c")]


def prefix_filtered(sets, percent):
    """Components over all pairs at the threshold: rarest tokens first, pairs that share one of those that must be shared."""
    from collections import Counter

    count = Counter(x for s in sets.values() for x in s)
    first, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(sets, key=lambda i: (len(sets[i]), i)):
        s = sorted(sets[i], key=lambda x: (count[x], x))
        head = s[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in head for j in first.get(x, ())}:
            if 100 * len(sets[j]) >= percent * len(sets[i]):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
        for x in head:
            first.setdefault(x, []).append(i)
    return {i: find(i) for i in sets}


def test_near_duplicates_of_ten_thousand_documents(spark, sf_dir):
    """Recall over all of sf0.1: the components are those of an exact prefix-filtered join."""
    from parcelflow.llm.words import shingles

    rows = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/documents.parquet")
    data = rows.select("doc_id", "text").toPandas()
    h, at = shingles([(t or "").encode() for t in data.text])
    sets = {int(i): frozenset(h[at[k] : at[k + 1]].tolist()) for k, i in enumerate(data.doc_id)}
    same_set = {}
    for i in sorted(sets):
        same_set.setdefault(sets[i] or i, i)
    head = prefix_filtered({i: s for s, i in ((sets[i], i) for i in same_set.values()) if s}, 75)
    want = {i: head[same_set[s]] if s else i for i, s in sets.items()}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(rows).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for p in (root / "parcelflow").rglob("*.py"):
        if "llm" not in p.relative_to(root / "parcelflow").parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
