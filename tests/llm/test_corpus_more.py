"""Importance resampling, conversation repair and chat formatting against plain forms of the same rules."""

import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow.llm import conversation_repair as cr
from parcelflow.llm import chat_format, features, importance
from parcelflow.llm.token_files import default_vocabulary
from parcelflow.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


# -- conversation repair ------------------------------------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) of [(role, text, fault)], by trying every edit from every state."""

    @functools.cache
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        nxt = {0: "u", 1: "u", 2: "a", 3: "u"}[state]
        to = {"u": 2, "a": 3}[nxt]
        name = {"u": "user", "a": "assistant"}[nxt]
        if inserts < 3:
            c, a, lines = best(i, to, inserts + 1)
            found.append((c + 5, "I" + a, (f"{name}:", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, lines = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if kept is not None:
                    c, a, lines = best(i + 1, kept, 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
                c, a, lines = best(i + 1, to, 0)
                found.append((c + extra + 1, "R" + a, (f"{name}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return best(0, 0, 0)


def repaired(rows):
    """The contract's row for the damaged rows of one conversation, in order."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.rstrip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(tuple((r, t, f) for (_, _, r, t), f in zip(rows, faults)))
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def digests(rows):
    groups = {conv: [] for conv, *_ in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    return {conv: repaired(sorted(own, key=key)) for conv, own in groups.items()}


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digest_rows(df):
    found = [(r["conv_id"], tuple(r[f] for f in FIELDS)) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_block_tables_equal_brute_force():
    t, rng = cr.BlockTables(), random.Random(3)
    assert len(t.vectors) < 100
    for n in [*range(8)] * 60:
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "x", rng.choice(["", "", "truncated", "blank"])) for _ in range(n)]
        digits = "".join("1" if f == "blank" else str("suao".find((r + "o")[0] if (r + "o")[0] in "sua" else "o") + (6 if f else 2)) for r, _, f in rows)
        at = sorted(rng.sample(range(n + 1), min(n, 2)))
        chunks = [c for c in (digits[a:b] for a, b in zip([0, *at], [*at, n])) if c]
        cost, edits, _ = t.repair(chunks)
        want = cheapest(tuple(rows))
        assert (cost, "".join(edits)) == want[:2], rows


def test_repair_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digest_rows(QUERIES["op12_conversation_repair"](spark, sf_dir)) == digests(rows)


def test_repair_of_odd_conversations(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "a.", "b", "c!  ", "d?\t", "e. f", "é ", "x" * 100_000 + "."]
    rows = []
    for conv in [None, -7, *range(60)]:
        for _ in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "s"]), rng.choice(texts)))
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(1500)]  # over several chunks and tasks
    rows += [(98, None, "user", "same.")] * 700 + [(97, 3, "assistant", f"{i % 50}.") for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "n": F.lit(5), "at": F.lit("x")})
    got = digest_rows(cr.repair_digests(df, cr.damage(df)))
    small = {c: w for c, w in digests([r for r in rows if r[0] not in (97, 98, 99)]).items()}
    assert {c: got[c] for c in small} == small
    for conv in (97, 98, 99):
        audit, own = got[conv][6], [r for r in damaged(rows) if r[0] == conv]
        assert len(audit.replace("I", "")) == len(own)
    assert got[98][:4] == (0, 0, len([r for r in damaged(rows) if r[0] == 98]) - 1, 0)


def test_repair_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_digests(df, cr.damage(df)).collect() == []


# -- chat formatting ----------------------------------------------------------------------------------------------------

ODD = "\\### Assistant: </turn> ok"


def told(rows):
    """n_turns, turns_sha256, loss_chars, loss_sha256 of each conversation, in the turns' order."""
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))
    return out


def formatted_rows(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_chat_query_equals_its_input(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert formatted_rows(QUERIES["op13_chat_format"](spark, sf_dir)) == told([*rows, (-7, 0, "user", ODD), (-7, 1, "assistant", ODD)])


def test_chat_of_odd_conversations(spark):
    rng = random.Random(11)
    bits = ["\\", "###", "</turn>", " ", "<|endoftext|>", "### Assistant: ", ":", "\n", "é", "語", "a", "#", "  ", "\x1c", "\u3000", "😀"]
    text = lambda: rng.choice([None, "", "x" * 50_000, *["".join(rng.choices(bits, k=rng.randrange(1, 12)))] * 12])
    roles = ["system", "user", "assistant", "assistant", None, "", "tool: x", "Assistant", "a</turn>###"]
    rows = [(conv, rng.choice([None, *range(6)]), rng.choice(roles), text()) for conv in [None, 0, -7, *range(1, 40)] for _ in range(rng.randrange(1, 9))]
    rows += [(70, t, "assistant", f"{t} \\") for t in range(1200)] + [(71, 0, "assistant", "again")] * 900
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "ids": F.lit(2), "at": F.lit("x")})
    assert formatted_rows(chat_format.format_digests(df)) == told(rows)
    assert chat_format.format_digests(df.limit(0)).collect() == []


def test_chat_ids_are_segments_between_marks(spark):
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(1, 0, "user", "Hi <|endoftext|> </turn>"), (1, 1, "assistant", "### Yes \\ it is")], "conv_id long, turn long, role string, text string")
    parts = chat_format.format_conversations(df).orderBy("at", "sub").collect()
    row = {c: [x for p in parts for x in p[c]] for c in ("ids", "mask")}
    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    first, own = t.get_vocab_size(), lambda s: t.encode(s, add_special_tokens=False).ids
    user, said = own("Hi \\<|endoftext|> \\</turn>"), own("\\### Yes \\\\ it is")
    assert row["ids"] == [first + 1, *user, first + 5, first + 2, *said, first + 5]
    assert row["mask"] == [0] * (len(user) + 3) + [1] * len(said) + [0]
    raw, _ = chat_format.codec(default_vocabulary()).decode(np.array(row["ids"]))
    assert raw.tobytes().decode() == "### User: Hi \\<|endoftext|> \\</turn> </turn>\n### Assistant: \\### Yes \\\\ it is </turn>\n"


# -- importance resampling ----------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def resampled(docs, target):
    """The contract's rows, one for each of docs [(doc_id, text)], sorted."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in buckets_of(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        own = buckets_of(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4] = rank
    return sorted(((*r[:4], None if isinstance(r[4], bool) else r[4]) for r in rows), key=str)


def test_feature_buckets_equal_crc32(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "Ab  cd", "é ÀB x1", "x" * 70 + " " + "y" * 64 + " " + "z" * 65 + " q", "\n\n", "k" * 20_000 + " r", " " * 9000 + "a b" + " " * 9000 + "c", " ".join(f"w{rng.randrange(900)}" for _ in range(9000))]
    texts += ["".join(rng.choices("aB é0_\n語.", k=rng.randrange(200))) for _ in range(200)]
    whole = features.chunks
    monkeypatch.setattr(features, "PIECE", 1 << 12)
    monkeypatch.setattr(features, "chunks", lambda t: whole(t, 2000))
    found, n = [[] for _ in texts], [0] * len(texts)
    for bucket, text, count in features.features([t.encode() for t in texts], 10_000):
        for b, i in zip(bucket.tolist(), text.tolist()):
            found[i].append(b)
        n = [a + int(b) for a, b in zip(n, count)]
    assert [sorted(f) for f in found] == [sorted(buckets_of(t)) for t in texts]
    assert n == [len(words(t)) for t in texts]


@pytest.mark.parametrize("segments", [1, 7])
def test_resampling_equals_brute_force(spark, monkeypatch, segments):
    monkeypatch.setattr(importance, "SEGMENTS", segments)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "日本", "X1"]
    docs = [(i % 350 if i % 9 else None, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 60])))) for i in range(400)]
    docs += [(5, None), (6, ""), (7, "long " * 50_000)] + [(1, "same words " * 20)] * 30
    target = [None, "", *[" ".join(rng.choices(vocabulary[:40], k=30)) for _ in range(30)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1), "tie": F.lit(2)})
    got = importance.importance_sample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, target)


def test_resampling_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_sample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in importance.importance_sample(one, none).collect()), key=str) == resampled([(1, "a b"), (None, None)], [])


def test_new_queries_match_sql(spark, sf_dir):
    from parcelflow.llm.queries import ORACLES
    from tests.oracle import connection, same

    same(spark, connection(sf_dir), sf_dir, QUERIES["op11_importance_resampling"], ORACLES["op11_importance_resampling"])


# -- compaction ---------------------------------------------------------------------------------------------------------


def test_a_store_that_cannot_be_written_raises(spark, tmp_path, monkeypatch):
    from parcelflow.llm import compaction

    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s", rows.schema)
    assert store.append(rows) == 1
    at = store._at
    monkeypatch.setattr(store, "_at", lambda name: at(name.replace("manifest/v", "nowhere/v") if name.endswith("2.json") else name))
    with pytest.raises(Exception) as e:
        store.append(rows)
    assert not isinstance(e.value, compaction.Conflict)
    monkeypatch.undo()
    assert store.version() == 1 and store.append(rows) == 2 and store.read().count() == 2


# -- the pipeline's first and last stage --------------------------------------------------------------------------------


def test_first_and_last_stage_equal_plain_forms(spark, sf_dir):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from parcelflow.llm import toxicity

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model, _ = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {i for i, t in texts.items() if model.score([t])[0] < toxicity.CUT}
    assert {r["doc_id"] for r in stages["toxicity"](spark, docs, sf_dir).collect()} == clean and 0 < len(clean) < len(texts)
    t, start, want = Tokenizer.from_file(default_vocabulary()), 0, []
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stages["tokens"](spark, docs, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_repeated_labels_and_texts_have_one_order(spark):
    from parcelflow.llm import toxicity

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (3, None), (3, "z"), (5, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (3, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: (r["toxic"], r["text"]) for r in toxicity.training_rows(docs, labels, "doc_id", "text").collect()}
    held = {i for i in (1, 3, 5) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert got == {i: v for i, v in {1: (1, "a"), 3: (0, "z")}.items() if i not in held}


# -- URL reputation -----------------------------------------------------------------------------------------------------


def test_a_planted_host_is_blocked_by_the_query(spark, tmp_path):
    """Of 60 hosts with 15 % bad pages one has 40 %; the query finds it, and its SQL agrees."""
    from parcelflow.llm.queries import ORACLES
    from tests.oracle import same

    import duckdb

    rng = random.Random(3)
    hosts = [f"www.site{i}.example.org" for i in range(59)] + ["bets.casino-win.net"]
    pages = [(i, f"https://{rng.choice(hosts)}/p/{i}", "<p>x</p>") for i in range(9000)]
    labels = [(i, 0 if rng.random() < (0.4 if "casino" in url else 0.15) else 1, 0) for i, url, _ in pages if i % 3]
    con = duckdb.connect()
    for name, rows, schema in (("pages", pages, "page_id long, url string, html string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    run, sql = QUERIES["op4_url_reputation"], ORACLES["op4_url_reputation"]
    blocked = {r["host"] for r in run(spark, f"file://{tmp_path}").where("verdict = 'block'").collect()}
    assert blocked == {"bets.casino-win.net"}
    same(spark, con, f"file://{tmp_path}", run, sql)
