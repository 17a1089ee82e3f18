"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm import bpe_tree, compact_windows, components, decontamination, hmm, quality_gbdt, quality_rules, sharding, simhash, suffix_dedup, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run int, bucket string, _row string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgéñ") for _ in range(RNG.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


PASSAGE = prose(70, 99)


def texts():
    out = {0: prose(120, 0), 1: None, 2: "", 3: " \n\t ", 4: prose(3000, 4), 5: "word", 6: "ab " * 60, 7: "x" * 250}
    out[10] = out[0]
    out[11] = out[0].replace(" ", "  ", 3)
    out[12] = prose(60, 12) + " " + PASSAGE + " " + prose(50, 13)
    out[13] = PASSAGE + "\n" + prose(40, 14)
    out[14] = prose(30, 15) + " " + PASSAGE.encode().upper().decode() + " " + prose(30, 16)
    out[15] = "\n".join([prose(12, 17)] * 5 + [prose(30, 18)])
    for k in range(20, 40):
        out[k] = prose(random.Random(k).randint(5, 200), k)
    return out


def rows():
    made = [(i, t, "en", "src", None if t is None else len(t), 1, "b", "r") for i, t in texts().items()]
    return [*made, made[0]]  # one row twice


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().lower().split()


def test_suffix_dedup_against_every_window(spark, docs, empty):
    r = random.Random(3)
    edges = [(100 + k, prose(r.randint(0, 9), k) + PASSAGE[r.randint(0, 60) : 300 + r.randint(0, 80)] + prose(r.randint(0, 9), -k)) for k in range(60)]
    edges += [(2**63 - 1, PASSAGE), (-(2**63), PASSAGE[:150] + "\0" * 120), (200, "\0" * 130)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "src", 1, 1, "b", "r") for i, t in edges], SCHEMA))
    seen, want = set(), []
    for i, t in sorted([(r[0], r[1]) for r in rows()] + edges):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    for size, hot in ((2_000, suffix_dedup.HOT), (1_000_000, suffix_dedup.HOT), (2_000, 8)):
        assert sorted(map(tuple, suffix_dedup.repeated_bytes(docs, size, hot).collect())) == sorted(want), (size, hot)
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(3)
    runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 30))}) for _ in range(7)]
    coded = [suffix_dedup.decoded(suffix_dedup.front_coded(x)) if x else iter(()) for x in runs]
    out = list(suffix_dedup.merged(coded))
    assert [s for s, *_ in out] == sorted(s for x in runs for s in x)
    for (a, *_), (b, known, *_) in zip(out, out[1:]):
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert known == n


def test_hash_tree_moves_only_where_weights_change(docs, empty):
    got = sharding.shards(docs).collect()
    assert len(got) == len(rows())
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    text = texts()
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw)) and r["grown_shard"] in (r["shard"], 24)
    tree = sharding.tree_of(24)
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (sharding.place(tree, key), sharding.place(tree.grow(24), key))
    few = sharding.shards(docs, 5).collect()
    assert all(r["shard"] == sharding.place(sharding.tree_of(5), str(r["doc_id"])) for r in few)
    keys = [str(k) for k in range(6000)]
    load = Counter(sharding.place(tree, k) for k in keys)
    assert len(load) == 24 and min(load.values()) > 150 and max(load.values()) < 350
    heavier = tree.reweigh(7, 3.0)
    for k in keys[:2000]:
        a, b = sharding.place(tree, k), sharding.place(heavier, k)
        assert a == b or 6 <= b <= 11  # into the region of shard 7
    assert sharding.shards(empty).count() == 0


def edit(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_against_full_alignment(spark, empty):
    items = [(1, prose(15, 71)), (2, prose(18, 72)), (3, ""), (4, None), (5, "short"), (None, "null id"), (6, prose(15, 71))]
    r = random.Random(8)

    def broken(t, n):
        t = list(t)
        for _ in range(n):
            k = r.randrange(len(t))
            t[k] = r.choice("xyz")
        return "".join(t)

    cases = [(0, items[0][1]), (1, prose(20, 1) + " " + items[1][1].upper().replace(" ", "\n") + " end"), (2, broken(items[0][1], 3)), (3, prose(30, 5) + broken(items[1][1], 6)), (4, prose(60, 6)), (5, None), (6, ""), (7, "a short one"), (8, broken(items[1][1], 40))]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x["item_ids"] for x in decontamination.decontamination(docs, bench).collect()}
    for i, t in cases:
        want = []
        for k, item in items:
            f = decontamination.folded(item)
            if k is not None and f and edit(f, decontamination.folded(t)) <= decontamination.budget(len(f)):
                want.append(k)
        assert got[i] == sorted(want), i
    kept = decontamination.clean(docs, bench)
    assert kept.columns == ["doc_id", "text"] and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if not x}
    assert decontamination.decontamination(empty, bench).count() == 0 and decontamination.clean(empty, bench).columns == empty.columns
    assert decontamination.decontamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    # In several blocks, with repeated rows and clashing names.
    twice = docs.unionByName(docs).withColumn("item_ids", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("_row", F.lit(2))
    blocks = decontamination.with_leaks(twice, bench, block=150).collect()
    assert len(blocks) == 2 * len(cases) and all(x["item_ids"] == got[x["_row"]["doc_id"]] for x in blocks)
    assert decontamination.clean(twice, bench).columns == twice.columns


def test_banded_alignment_against_the_full_table():
    import numpy as np

    r = random.Random(21)
    docs, bench = [], [(k, "".join(r.choice("abc é日") for _ in range(r.randint(10, 120)))) for k in range(60)]
    template = prose(25, 40)
    bench += [(100 + k, f"{template} {k}{'x' * (k % 5)}") for k in range(20)]
    for k in range(120):
        t = list(r.choice(bench)[1])
        for _ in range(r.randint(0, 12)):
            p = r.randrange(len(t))
            t[p : p + r.randint(0, 1)] = r.choice(["", "q", "日"])
        docs.append(prose(r.randint(0, 9), k) + " " + "".join(t) + " " + prose(r.randint(0, 9), -k))
    items = decontamination.Items(bench)
    found = items.find([decontamination.folded(t) for t in docs])
    for t, got in zip(docs, found):
        f = decontamination.folded(t)
        assert got == {k for k, x in enumerate(items.texts) if edit(x, f) <= decontamination.budget(len(x))}
    small, decontamination.PIECE = decontamination.PIECE, 50
    try:
        assert items.find([decontamination.folded(t) for t in docs]) == found
    finally:
        decontamination.PIECE = small
    long = decontamination.points("ab" * 700_000 + docs[0])
    assert len(decontamination._grams(long)) == len(long) - decontamination.Q + 1 and len(np.unique(decontamination._grams(long[:1000]))) == 2


def test_simhash_components_against_all_pairs(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = {}
    for i, t in texts().items():
        h = simhash.shingle_hashes(t or "").tolist()
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((r[0], f"{prints[r[0]]:016x}", comp[r[0]]) for r in rows())
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values()))
    assert simhash.near_duplicates(empty).count() == 0


def test_gray_tree_finds_every_pair(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) ^ (np.uint64(1) << np.uint64(j)) for k, j in ((0, 0), (1, 5), (9, 33), (62, 63), (1, 6))]))
    tree = simhash.GrayTree(fps)
    got = {tuple(sorted((int(tree.fps[i]), int(tree.fps[j])))) for a, b in tree.pairs() for i, j in zip(a, b)}
    want = {tuple(sorted((int(x), int(y)))) for k, x in enumerate(fps) for y in fps[k + 1 :] if int(x ^ y).bit_count() <= 2}
    assert got == want and want


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    fps = [(7 << 48) | (9 << 32) | x for x in range(0, 600, 3)]
    monkeypatch.setattr(simhash, "HOT", 10)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    near = {x: {y for y in fps if (x ^ y).bit_count() <= 2} for x in fps}
    for x in fps:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert roots.get(x, x) == min(seen)


def test_no_table_of_all_keys_is_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        fps = simhash.stored(spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).cast("binary").alias("row_key"), F.shiftleft("id", 20).alias("fp")))
        dealt = simhash._dealt(simhash._keys(fps.select("fp").distinct()))
        dealt.count()
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {k: 0 for k in range(1, 51)} | {101: 100}


def test_token_counts_equal_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    text = texts()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((r[0], len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in rows())
    assert text and token_counts.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    c, r = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model")), random.Random(2)
    assert c.splits
    for _ in range(2000):
        s = "".join(r.choice([" ", "  ", "a", "the", "▁", "\n", "é", "<s>", "12", "日", "\x00", ".", "ﬁ"]) for _ in range(r.randint(0, 12)))
        assert c.count(s) == len(sp.encode(s)), repr(s)


def test_rule_ledger_against_plain_python(docs, empty):
    got = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    assert len(got) == len(rows())
    text = texts()
    for r in got:
        w = [x for x in (text[r["doc_id"]] or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
        lines = [x for x in (text[r["doc_id"]] or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r["kept"] or not r["base_failed"])
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    assert quality_rules.ledger(empty).count() == 0
    led = quality_rules.ledger(docs).cache()
    for r in quality_rules.ablation(led).collect():
        rule = next(x for x in quality_rules.RULES if x.name == r["rule"])
        bits = [x["fail_bits"] for x in got]
        assert r["n_failed"] == sum(1 for b in bits if b & rule.mask) and r["n_failed_alone"] == sum(1 for b in bits if b == rule.mask)
    assert quality_rules.shared_bits(led).first()["n_docs"] == len(rows())


def test_compact_windows_find_planted_passages_only(docs, empty):
    got = {r["doc_id"]: r for r in compact_windows.near_duplicate_passages(docs).collect()}
    text = texts()
    for i in (13, 14):
        w = words_of(text[i])
        marked = {k for s in got[i]["spans"] for k in range(s["first_word"], s["last_word"] + 1)}
        at = next(k for k in range(len(w)) if w[k : k + 70] == words_of(PASSAGE))
        assert set(range(at, at + 70)) <= marked and len(marked) <= 76 and got[i]["class_id"] == 12 and 12 in got[i]["repeats_of"]
    assert got[10]["n_repeated"] == got[10]["n_words"] == 120 and got[10]["class_id"] == 0
    for i in [0, 4, 12, *range(20, 40)]:
        assert got[i]["n_repeated"] == 0
    cut = {r["doc_id"]: r["text"] for r in compact_windows.cut(docs).collect()}
    assert 10 not in cut and cut[12] == text[12] and not set(words_of(PASSAGE)[10:20]) <= set(words_of(cut[13])) and cut[1] is None and cut[2] == ""
    assert compact_windows.cut(docs).columns == docs.columns
    assert compact_windows.near_duplicate_passages(empty).count() == 0


def test_compact_windows_bear_edits(spark):
    base = prose(90, 500).split()
    near = list(base)
    near[45] = "changed"
    far = [w if k % 4 else "other" for k, w in enumerate(base)]
    rows_ = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    got = {r["doc_id"]: r for r in compact_windows.near_duplicate_passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got[2]["n_repeated"] >= 80 and got[2]["class_id"] == 1 and got[3]["n_repeated"] == 0


def shingle_sets(text):
    w = words_of(text)
    each = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    return [set(each[k : k + 46]) for k in range(len(each) - 45)]


def alike(a, b):
    return any(len(x & y) >= 0.8 * len(x | y) for x in shingle_sets(a) for y in shingle_sets(b))


def classes(links, ids):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_compact_windows_ask_every_holder(spark):
    r, text = random.Random(21), {}
    for k in range(60):  # the third is like the second and unlike the first
        base = [f"{r.choice(WORDS)}{k}x{j}" for j in range(60)]
        near, far = list(base), list(base)
        near[r.randrange(10, 25)] = "once"
        far[:] = near
        far[r.randrange(35, 50)] = "twice"
        text |= {1000 + 10 * k: " ".join(base), 1001 + 10 * k: " ".join(near), 1002 + 10 * k: " ".join(far)}
    bank = [prose(10, 900 + k).replace(".", "") for k in range(40)]
    for k in range(200):
        text[k] = " ".join(r.sample(bank, 9))
    for k in range(40):  # six lines of an earlier document among lines in another order
        at = r.randrange(4)
        text[5000 + k] = prose(20, 3000 + k) + " " + " ".join(text[r.randrange(200)].split()[at * 10 : at * 10 + 60]) + " " + prose(20, 4000 + k)
    got = {x["doc_id"]: x for x in compact_windows.near_duplicate_passages(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    for k in range(60):
        a, b, c = (1000 + 10 * k + j for j in range(3))
        assert (a in got[b]["repeats_of"]) == alike(text[a], text[b]) and got[c]["class_id"] == classes([x for x in ((a, b), (b, c), (a, c)) if alike(text[x[0]], text[x[1]])], (a, b, c))[c]
    for k in range(40):
        marked = {j for s in got[5000 + k]["spans"] for j in range(s["first_word"], s["last_word"] + 1)}
        assert set(range(20, 80)) <= marked, k


def test_compact_windows_find_every_pair_at_the_bound(spark):
    r, text = random.Random(22), {}
    for k in range(400):
        base = [f"{r.choice(WORDS)}{k}y{j}" for j in range(50)]
        near = list(base)
        near[r.randrange(4, 46)] = "changed"
        text |= {2 * k: " ".join(base), 2 * k + 1: " ".join(near)}
    got = {x["doc_id"]: x for x in compact_windows.near_duplicate_passages(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    assert all(alike(text[2 * k], text[2 * k + 1]) and got[2 * k + 1]["repeats_of"] == [2 * k] and got[2 * k + 1]["class_id"] == 2 * k for k in range(400))


def tokens_of(*parts):
    import pyarrow as pa

    return compact_windows.Shingles(pa.table({"run": pa.array([0], pa.int32()), "doc_id": pa.array([1]), "text": [" ".join(x for p in parts for x in p)]})).tokens


def test_both_sides_of_an_inserted_word_are_marked():
    w = [f"w{k}" for k in range(120)]
    mine, other = tokens_of(w[:60], ["more"], w[60:]), tokens_of(w)
    assert compact_windows.verified(mine, 0, len(mine), other, 0) == compact_windows.verified(mine, 0, len(mine), other, -1) == [(0, 117)]


def test_short_passages_with_a_change_near_an_end():
    w, ends = [f"w{k}" for k in range(50)], [[f"{x}{k}" for k in range(20)] for x in "abcd"]
    for at in (2, 47):
        near = [*w[:at], "changed", *w[at + 1 :]]
        mine, other = tokens_of(ends[0], near, ends[1]), tokens_of(ends[2], w, ends[3])
        assert compact_windows.similarity(mine[20:66], other[20:66]) == 43 / 49
        marked = {k for a, b in compact_windows.verified(mine, 12, 74, other, 12) for k in range(a, b)}
        assert set(range(23, 63)) <= marked <= set(range(20, 66))


def test_nothing_to_compare_with():
    import numpy as np

    tokens = np.arange(100, dtype=np.uint64)
    assert compact_windows.verified(tokens, 0, 60, tokens[:0], 0) == []
    assert compact_windows.verified(tokens, 0, 60, tokens[:60], 0) == [(0, 60)]


def test_candidates_of_little_support_are_verified():
    import pickle

    import numpy as np
    import pyarrow as pa
    import zstandard

    from tidemark.llm.runs import pack

    mine = np.arange(60, dtype=np.uint64)
    a, b = mine.copy(), mine.copy()
    a[10:15], b[45:50] = range(100, 105), range(200, 205)
    found = [(0, 0, 14, other, 0, n, 0, 60) for other, n in ((1, 5), (2, 1), (3, 1))]
    state = {"doc_id": np.array([9]), "held": [True], "text_md5": [b""], "n_words": np.array([64]), "found": found, "at": [(k, 0, 60) for k in range(3)], "tokens": {0: mine}}
    states = pa.table({"blob": [zstandard.compress(pickle.dumps(state))]})
    replies = pa.table({"blob": [pack({"k": np.arange(3), "size": np.full(3, 60), "tokens": np.concatenate((a, b, a))})]})
    got = compact_windows._judged(states, replies).to_pylist()[0]
    assert got["spans"] == [{"first_word": 0, "last_word": 63}] and got["repeats_of"] == [1, 2]  # the third repeats the first


def test_quality_trees_learn_and_hold_out(spark, docs, empty):
    made = [(k, prose(80, k) if k % 3 else " | ".join(prose(80, k).split()), "en") for k in range(600)]
    d = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(600)] + [(None, 1, 0), (5000, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_gbdt.quality(d, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.97
    assert quality_gbdt.quality(docs, labels.limit(0)).filter("score = 0.5").count() == len(rows())
    assert quality_gbdt.quality(empty, labels).count() == 0


def test_trees_against_a_plain_search_and_a_plain_walk():
    import numpy as np

    r = np.random.default_rng(2)
    n, nf = 400, len(quality_gbdt.STATISTICS)
    x = r.normal(size=(n, nf)).round(2)
    y = ((x[:, 3] > 0.2) ^ (r.random(n) < 0.1)).astype(float)
    m = quality_gbdt.fit(x, y)
    b = m.binned(x)
    # Every score is the sum of the leaves that a walk from each root ends in.
    for k in range(0, n, 7):
        total = m.start
        for at in m.roots:
            while m.left[at] >= 0:
                at = m.left[at] + int(x[k, m.statistic[at]] > m.edges[m.statistic[at]][m.bin[at]] if m.bin[at] < len(m.edges[m.statistic[at]]) else 0)
            total += m.value[at]
        assert m.raw(b[k : k + 1])[0] == pytest.approx(total)
    # The first split is the best of all statistics and thresholds, by the gain of the second-order loss.
    p = 1 / (1 + np.exp(-m.start))
    g, h = y - p, np.full(n, p * (1 - p))
    worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality_gbdt.L2)
    best = max(
        (worth(left) + worth(~left) - worth(np.ones(n, bool)), k, c)
        for k in range(nf) for c, e in enumerate(m.edges[k]) for left in [x[:, k] <= e] if min(left.sum(), (~left).sum()) >= quality_gbdt.LEAST
    )
    root = m.roots[0]
    assert (m.statistic[root], m.bin[root]) == best[1:]
    left = x[:, best[1]] <= m.edges[best[1]][best[2]]
    assert m.value[m.left[root]] == pytest.approx(quality_gbdt.RATE * g[left].sum() / (h[left].sum() + quality_gbdt.L2)) or m.left[m.left[root]] >= 0
    for half in (0.0, 1.0):
        assert quality_gbdt.fit(x, np.full(n, half)).score(x)[0] == pytest.approx((half * n + 1) / (n + 2))


def test_bpe_tree_equals_the_library(docs, empty):
    import numpy as np
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe_tree.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True).collect()
    text = texts()
    for r in got:
        ids = enc.encode_ordinary(text[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()
    assert len(got) == len(rows()) and bpe_tree.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0
    other = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    parts = [" ", "  ", "a", "the", "\n", "\r\n", "é", "'s", "'r", "'", "l", "e", "12", "½", "日", ".", "!?", " \n", "\x85", chr(1368), chr(2191), chr(73184), "🙂"]
    r = random.Random(6)
    for pattern in (public_tokenizers.PATTERN, other):
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for leaf, window in ((1, 1), (3, 1), (5, 2), (16, 4)):
            tree = bpe_tree.Tree(path, pattern, leaf, window)
            for _ in range(700):
                s = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
                ids = tree.encode(s)
                assert ids == enc.encode_ordinary(s), (pattern, leaf, repr(s))
                assert tree.decode(ids) == s.encode()
    tree = bpe_tree.Tree(path, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for s in ("x" * 40_000, "日本" * 9_000, "\u0558" * 5_000, " " * 3_000 + "a", "ab cd " * 9_000, "\n" * 2_000):
        assert tree.encode(s) == enc.encode_ordinary(s)
    for bad in (r"(?<=a)b|.", r"a*", r"\bfoo|.", r"(ab)+|.", r"^a|."):
        with pytest.raises(ValueError):
            bpe_tree.Tree(path, bad)


def test_bpe_tree_joins_in_any_order():
    tree, r = bpe_tree.Tree(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, window=2), random.Random(8)
    for _ in range(300):
        s = "".join(r.choice([" ", "  ", "a", "the", "\n", "'s", "'", "12", "."]) for _ in range(30))
        i, j = sorted(r.sample(range(len(s) + 1), 2))
        a, b, c = (tree.scanned(s, s, x, y) for x, y in ((0, i), (i, j), (j, len(s))))
        left, right = tree.join(s, s, tree.join(s, s, a, b), c), tree.join(s, s, a, tree.join(s, s, b, c))
        done = [n.pieces + tree.scanned(s, s, n.rest, len(s), last=True).pieces for n in (left, right)]
        assert done[0] == done[1] == [tree.ids_of(m) for m in tree.pattern.findall(s)]
    words = {''.join(r.choice('abcdeé  日xyz') for _ in range(r.randint(1, 20))).encode() for _ in range(3000)}
    words = [w for w in words if len(w) <= bpe_tree.SHORT and w not in tree.ranks]
    assert tree.merge_all(words) == [tree.merged(w) for w in words] and tree.merge_all([]) == []


def test_markov_model_counts_and_adds_up(docs, empty):
    import itertools

    import numpy as np

    got = hmm.scores(docs, rounds=2, run_bytes=2_000).collect()
    token = {r[0]: [*words_of(r[1]), None] for r in rows()}
    train = [w for r in rows() if zlib.crc32(str(r[0]).encode()) % 7 != 2 for w in token[r[0]]]
    c = Counter(train)
    for r in got:
        t = token[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in c for w in t), len(train))
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (len(train) + len(c) + 1)) for w in t))
        assert r["score"] < 0
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert len(got) == len(rows()) and hmm.scores(empty).count() == 0
    # The scaled recursion against the sum over all state paths.
    m = hmm.Model.first(np.arange(hmm.CLASSES, dtype=float), 3)
    seq = np.array([5, 9, 2, 1])
    total = sum(m.start[p[0]] * np.prod([m.step[a, b] for a, b in zip(p, p[1:])]) * np.prod([m.emit[s, o] for s, o in zip(p, seq)]) for p in itertools.product(range(3), repeat=4))
    assert hmm.forward(m, seq, np.array([4]), np.array([0]))[0][0] == pytest.approx(np.log10(total))
    # One round of Baum-Welch raises the likelihood.
    seqs = [np.random.default_rng(k).integers(2, 40, 30) for k in range(20)]
    before = sum(hmm.forward(m, s, np.array([30]), np.array([0]))[0][0] for s in seqs)
    counts = hmm.expected(m, seqs)
    assert counts[: 3].sum() == pytest.approx(20, rel=1e-4) and counts[12:].sum() == pytest.approx(600, rel=1e-4)
    after = hmm.Model.of_counts(counts, np.zeros(hmm.CLASSES), 3)
    assert sum(hmm.forward(after, s, np.array([30]), np.array([0]))[0][0] for s in seqs) > before


def test_markov_scores_against_a_plain_model(docs):
    """Counts, Baum-Welch and the forward recursion once more, document by document and state by state."""
    import numpy as np

    rounds, states = 2, 3
    got = sorted((r["doc_id"], r["score"]) for r in hmm.scores(docs, rounds=rounds, states=states, run_bytes=2_000).collect())
    texts_of = [(r[0], [*words_of(r[1]), None]) for r in rows()]
    train = [t for i, t in texts_of if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    kind = lambda w: hmm.END if w is None else hmm.RARE if c[w] <= 1 else hmm.class_of(w)
    mass, types = np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES)
    for w, n in c.items():
        mass[kind(w)] += n
        types[kind(w)] += 1
    rare = int(types[hmm.RARE])
    inside = lambda w: 1.0 if w is None else c[w] / mass[kind(w)] if c[w] > 1 else 0.5 / rare if c[w] == 1 else 0.5 if rare else 1.0
    weight = hmm.class_weights(mass, types)
    m = hmm.Model.first(weight, states)

    def passes(t):
        x, alpha, scale = [kind(w) for w in t], [], []
        for k, o in enumerate(x):
            a = (m.start if k == 0 else [sum(alpha[-1][i] * m.step[i, j] for i in range(states)) for j in range(states)]) * m.emit[:, o]
            scale.append(sum(a))
            alpha.append(np.array(a) / scale[-1])
        return x, alpha, scale

    for _ in range(rounds):
        # All probabilities of a step add up to one: over the events of each class, and the unknown word.
        events = np.zeros(hmm.CLASSES)
        for w in c:
            events[kind(w)] += inside(w)
        events[hmm.RARE] += 0.5 if rare else 1.0
        assert (m.emit @ events == pytest.approx(np.ones(states))) and (m.step.sum(1) == pytest.approx(np.ones(states))) and m.start.sum() == pytest.approx(1)
        start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, hmm.CLASSES))
        for t in train:
            x, alpha, scale = passes(t)
            beta = np.ones(states)
            for k in range(len(x) - 1, -1, -1):
                at = alpha[k] * beta
                emit[:, x[k]] += at
                if k:
                    onward = beta * m.emit[:, x[k]] / scale[k]
                    step += np.outer(alpha[k - 1], onward) * m.step
                    beta = m.step @ onward
                else:
                    start += at
        m = hmm.Model.of_counts(np.concatenate((start, step.ravel(), emit.ravel())), weight, states)
    want = sorted((i, sum(np.log10(passes(t)[2])) + sum(np.log10(inside(w)) for w in t)) for i, t in texts_of)
    assert [i for i, _ in got] == [i for i, _ in want]
    for (_, a), (_, b) in zip(got, want):
        assert a == pytest.approx(b, rel=1e-4, abs=1e-3)


def test_null_ids(spark):
    d = spark.createDataFrame([Row(doc_id=None, text=prose(90, 1)), Row(doc_id=None, text=None), Row(doc_id=4, text=prose(90, 1))], "doc_id long, text string")
    assert suffix_dedup.repeated_bytes(d).filter("doc_id IS NULL AND n_removed > 0").count() == 1
    assert {r["component_id"] for r in simhash.near_duplicates(d).collect()} == {4, None}
    assert simhash.keep_one(d).count() == 3
    assert sharding.shards(d).count() == hmm.scores(d).count() == compact_windows.near_duplicate_passages(d).count() == 3
    assert compact_windows.cut(d).count() == 3


def test_pipeline_against_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame([r[:5] for r in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    d.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    leak = prose(15, 801)
    spark.createDataFrame([(1, leak)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    more = spark.createDataFrame([(50, prose(40, 802) + " " + leak + " " + prose(40, 803), "en", "s", 0)], d.schema)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "byte-level BPE"]
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, str(tmp_path))
        assert out.columns == step.columns, name
        step = out
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 50 not in got and 10 not in got and {0, 4, 12} <= set(got) and not set(got) & {1, 2, 3, 5, 6}
    want = _pipeline_by_hand([(r[0], r[1] or "") for r in rows()] + [(50, more.first()["text"])], leak)
    assert {i: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for i, r in got.items()} == want


def _pipeline_by_hand(docs, leak):
    import re

    import numpy as np
    import tiktoken

    space = " \t\n\r\x0b\x0c"
    split = lambda t: [x for x in re.split(f"[{space}]+", t) if x]

    def passes_rules(t):
        w, lines = split(t), [x for x in t.split("\n") if x.strip(space)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)} if len(w) < 400 else set()
        chars, letters, upper = sum(map(len, w)), sum(c.isascii() and c.isalpha() for c in t), sum("A" <= c <= "Z" for c in t)
        twice, n = len(lines) - len(set(lines)), len(w)
        fails = [
            n < 20, 100 * len(again) > 30 * n, 10 * sum(c in "#*$%&|<>" for c in t) > n, chars < 2 * n, chars > 25 * n, twice >= 3 and 100 * twice > 30 * len(lines),
            letters >= 20 and 2 * upper > letters, 10 * sum(x == y for x, y in zip(w, w[1:])) > 3 * n,
        ]
        return not any(fails)

    docs = [(i, t) for i, t in docs if passes_rules(t)]
    prints = [(i, t, simhash.fingerprint(t)) for i, t in docs]
    group = {i: i for i, _, _ in prints}
    for _ in prints:
        for i, _, f in prints:
            for j, _, g in prints:
                if (f ^ g).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    docs = sorted({(i, t) for i, t, _ in prints if group[i] == i})
    # Passages of 50 words and more that an earlier document has, too: here all repeats are word for word.
    seen, cut = set(), []
    for i, t in docs:
        w = words_of(t)
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {k + j for k, x in enumerate(runs) if x in seen for j in range(50)}
        seen.update(runs)
        places = [m.span() for m in re.finditer(f"[^{space}]+", t)]
        out, k = "", 0
        while k < len(places):  # the text between kept words stays, that inside a passage goes
            if k in gone:
                first = k
                while k + 1 in gone:
                    k += 1
                out += t[(places[first - 1][1] if first else 0) : places[first][0]]
            else:
                out += t[(places[k - 1][1] if k else 0) : places[k][1]]
            k += 1
        cut.append((i, (out + t[places[-1][1] :]) if gone else t))
    docs = [(i, t) for i, t in cut if split(t)]
    item = decontamination.folded(leak)
    docs = [(i, t) for i, t in docs if edit(item, decontamination.folded(t)) > decontamination.budget(len(item))]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {i: (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for i, t in docs for ids in [enc.encode_ordinary(t)]}


def test_rows_that_repeat_an_id_are_told_apart_by_their_text(spark):
    x, y, z = prose(80, 301), prose(90, 302), prose(30, 303)
    d = spark.createDataFrame([(2, x), (5, x), (5, y), (5, y), (None, z), (None, z), (None, x), (7, None), (8, "")], "doc_id long, text string")
    kept = simhash.keep_one(d).collect()
    assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in kept) == sorted([(False, 2, x), (False, 5, y), (False, 7, ""), (True, 0, x), (True, 0, z), (True, 0, z)])
    assert simhash.keep_one(d.limit(0)).count() == 0
    long = prose(60, 305) + " " + x + " " + prose(40, 306)
    d = spark.createDataFrame([(1, x), (5, "few words"), (5, long), (5, y), (5, long), (-(2**63), y), (None, x), (6, None)], "doc_id long, text string")
    cut = sorted(map(tuple, compact_windows.cut(d).collect()), key=str)
    left = prose(60, 305) + "  " + prose(40, 306)
    assert cut == sorted([(1, x), (5, "few words"), (5, left), (5, left), (-(2**63), y), (None, x), (6, None)], key=str)
    assert compact_windows.cut(d.limit(0)).count() == 0


def test_a_hub_is_a_component(spark):
    pairs = [(0, k) for k in range(1, 3000)] + [(k, 5000 + k) for k in range(1, 40)] + [(9001, 9000), (None, 3), (4, 4)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in (*range(1, 3000), *range(5001, 5040))} | {9001: 9000}


def test_labels_that_disagree_and_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(20, 40)] + [(k, 1, "y") for k in range(20, 40)], "doc_id long, quality int, text string")
    one = spark.createDataFrame([(k, 1) for k in range(20, 40)], "doc_id long, quality int")
    score = lambda d, l: sorted((r["doc_id"], r["score"]) for r in quality_gbdt.quality(d, l).collect())
    assert score(docs.withColumns({"y": F.lit(0), "x": F.lit(1), "held_out": F.lit(True)}), labels) == score(docs, one)


def test_block_borders_change_nothing(spark):
    import numpy as np

    from tidemark.llm import runs

    r = random.Random(12)
    words = [r.choice(WORDS) for _ in range(90_000)] + ["y" * 300_000] + [r.choice(WORDS) for _ in range(2_000)]
    raw = " ".join(words).encode()
    assert len(raw) > 3 * compact_windows.BLOCK
    starts, hashes = compact_windows.word_hashes(np.frombuffer(raw, np.uint8))
    assert len(starts) == len(words) and len({(w, int(h)) for w, h in zip(words, hashes)}) == len(set(words)) == len(set(hashes.tolist()))
    text = np.frombuffer(raw[: suffix_dedup.BLOCK + 5_000], np.uint8)
    h = suffix_dedup.gram_hashes(text)
    at = suffix_dedup.BLOCK - 60
    assert len(h) == len(text) - suffix_dedup.GRAM + 1 and h[at : at + 80].tolist() == suffix_dedup.gram_hashes(text[at : at + 80 + suffix_dedup.GRAM - 1]).tolist()
    small, runs.STRETCH = runs.STRETCH, 7
    try:
        x = np.array([r.randrange(50) for _ in range(300)], np.uint64)
        for w in (1, 2, 5, 51):
            want = sorted({p + k for p in range(len(x) - w + 1) for k in range(w) if x[p + k] == x[p : p + w].min()})
            assert runs.minimizers(x, w).tolist() == want
    finally:
        runs.STRETCH = small
    # A document of several blocks that repeats a part of itself and of another.
    long = " ".join(words[:60_000])
    texts_of = [(1, long[1000:4000]), (2, long + long[200_000:260_000])]
    got = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.repeated_bytes(spark.createDataFrame(texts_of, "doc_id long, text string")).collect()}
    seen, want = set(), {}
    for i, t in texts_of:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        want[i] = sum(gone)
    assert got == want and want[2] > 60_000


def test_passages_are_found_behind_documents_that_quote_parts(spark):
    """Earlier documents quote fragments of a passage; two later ones hold all of it, one with changed words."""
    r = random.Random(33)
    passage = [r.choice(WORDS) + str(k) for k in range(80)]
    quotes = [(k, prose(20, 900 + k) + " " + " ".join(passage[(a := r.randrange(0, 45)) : a + 35]) + " " + prose(20, 950 + k)) for k in range(40)]
    changed = list(passage)
    changed[40] = "other"
    whole = [(100, prose(30, 1000) + " " + " ".join(passage) + " " + prose(30, 1001)), (101, prose(25, 1002) + " " + " ".join(passage)), (102, " ".join(changed) + " " + prose(40, 1003))]
    got = {x["doc_id"]: x for x in compact_windows.near_duplicate_passages(spark.createDataFrame(quotes + whole, "doc_id long, text string")).collect()}
    assert got[101]["n_repeated"] >= 80 and got[102]["n_repeated"] >= 79 and got[100]["n_repeated"] == 0
    assert got[100]["class_id"] == got[101]["class_id"] == got[102]["class_id"] == 100
    assert all(got[k]["n_repeated"] == 0 for k in range(40))


def test_near_duplicate_passages_recall(spark):
    """Planted pairs of 60-word passages with one or two changed words, held against brute-force Jaccard."""
    r = random.Random(44)
    rows_of, planted = [], []
    for k in range(120):
        p = [r.choice(WORDS) + r.choice("abc") for _ in range(60)]
        q = list(p)
        for at in r.sample(range(60), 1 + k % 2):
            q[at] = f"changed{k}"
        tokens = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        a, b = tokens(p), tokens(q)
        rows_of += [(2 * k, prose(20, 5000 + k) + " " + " ".join(p) + " " + prose(20, 6000 + k)), (2 * k + 1, prose(20, 7000 + k) + " " + " ".join(q) + " " + prose(20, 8000 + k))]
        if len(a & b) / len(a | b) >= 0.8:
            planted.append(k)
    got = {x["doc_id"]: x for x in compact_windows.near_duplicate_passages(spark.createDataFrame(rows_of, "doc_id long, text string")).collect()}
    found = [k for k in planted if got[2 * k + 1]["n_repeated"] >= 48 and got[2 * k + 1]["class_id"] == 2 * k]
    assert len(planted) > 60 and len(found) == len(planted)


def test_windows_of_many_near_copies_do_not_all_ask_one_another():
    import numpy as np

    for n in (200, 2000):  # one token, every window different
        key, every = np.zeros(n, np.uint64), np.arange(n)
        a, b, first, more = compact_windows.met(key, every.astype(np.uint64), every, np.zeros(n, np.int64), np.ones(n, bool))
        assert len(a) <= 8 * n and (b < a).all() and first.all() and more.sum() == n - 9
    r = random.Random(55)
    rows_ = sorted((r.randrange(3), r.randrange(3), k) for k in range(200))
    key, of, doc = (np.array([x[k] for x in rows_]) for k in range(3))
    first, more, told = (np.array([r.random() < p for _ in rows_]) for p in (0.5, 0.7, 0.8))
    small, compact_windows.AT_ONCE = compact_windows.AT_ONCE, 50
    try:
        got = [x for a, b in compact_windows.left_over(key, of, doc, np.zeros(200, np.int64), first, more, told) for x in zip(a.tolist(), b.tolist())]
    finally:
        compact_windows.AT_ONCE = small
    want = {(a, b) for a in range(200) for b in range(200) if more[a] and first[b] and key[a] == key[b] and doc[b] < doc[a] and not (told[a] and of[a] == of[b])}
    assert len(got) == len(set(got)) and set(got) == want


def test_many_near_copies_lose_no_word_and_no_class(spark):
    """Copies with one to four changed words, more than a window asks at first, held against all pairs of passages."""
    r, text = random.Random(66), {}
    for g in range(3):
        made = [[f"{r.choice(WORDS)}{g}z{j}" for j in range(66)]]
        for k in range(30):
            near = list(r.choice(made))
            for at in r.sample(range(66), r.randrange(1, 5)):
                near[at] = f"changed{g}z{k}z{at}"
            made.append(near)
        text |= {g * 1000 + k: " ".join(w) for k, w in enumerate(made)}
    got = {x["doc_id"]: x for x in compact_windows.near_duplicate_passages(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    only = {x["doc_id"]: x["spans"] for x in compact_windows.passages(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    sets, links = {i: shingle_sets(t) for i, t in text.items()}, []
    for i in text:
        marked = {k for s in got[i]["spans"] for k in range(s["first_word"], s["last_word"] + 1)}
        want, own = set(), words_of(text[i])
        for o in [o for o in text if o // 1000 == i // 1000 and o < i]:
            every = set().union(*sets[o])
            for k, x in enumerate(sets[i]):
                if any(len(x & y) >= 0.8 * len(x | y) for y in sets[o]):
                    links.append((i, o))
                    shared = [j for j in range(k, k + 46) if tuple(own[j : j + 5]) in every]
                    want |= set(range(shared[0], shared[-1] + 5))
        assert want <= marked, (i, want - marked)
        assert want <= {k for s in only[i] for k in range(s["first_word"], s["last_word"] + 1)}
    root = classes(set(links), text)
    assert all(got[i]["class_id"] == root[i] for i in text) and len(set(root.values())) < len(text) - 30
