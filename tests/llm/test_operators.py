"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rulewright.llm import bpe, fingerprint, graph, jaccard_join, language, licences, neighbours, packing, passages, pii, quality
from rulewright.llm import words as W
from rulewright.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and other columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a b c d e f g", "en"), (1, "a b c d e f g", "en"), (2, "", "en"), (3, None, None), (None, "x y z", "fr"), (None, None, None), (4, long, "en"), (5, "a" * 50_000, "de"), (6, " \n\n ", "en"), (7, "a b c d e f g", "en"), (8, "é\x00𝒳 <|endoftext|> Σ", "es")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.select("doc_id", "text", "lang", F.lit(1).alias("uid"), F.lit("x").alias("Doc_Id"), F.lit(None).cast("string").alias("base"), F.lit("s").alias("source"), F.lit(0).alias("n_chars"), F.lit(2).alias("score"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall("[0-9a-z_\u0080-\U0010ffff]+", text.lower())


# 1


def test_licences(spark, docs, texts):
    known = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under the Apache License, Version 2.0.": "Apache", "Released under the MIT License.": "MIT", "All rights reserved.": "Reserved"}
    extra = spark.createDataFrame([(10_000 + i, "Some words.\n" + n + "\nMore words.") for i, n in enumerate(known)] + [(20_000, "He lost his driving license and all rights were explained by the public.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs.select("doc_id", "text").unionByName(extra)).collect()}
    assert len(got) == len(texts) + 6
    for i, family in enumerate(known.values()):
        assert got[10_000 + i].licences == family and got[10_000 + i].findings.startswith("1:")
    assert got[20_000].licences == "" and got[20_000].n_unknown == 1
    for doc_id, text in texts.items():
        assert got[doc_id].licences == ",".join(sorted({f for n, f in known.items() if n in text}))


def test_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    isc = "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted"
    rows = [(1, "Some words.\n \n\n" + mit + "\n\nMore words."), (2, "A title\n\n" + bsd), (3, isc), (4, "He lost his driving license\nand all rights were\nexplained by the public."), (5, "First words.\nReleased under the MIT License.\nMore words.")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licences for i in range(1, 6)] == ["MIT", "BSD", "ISC", "", "MIT"]
    assert got[1].findings.startswith("3:MIT:") and got[2].findings.startswith("2:BSD:") and got[3].findings.startswith("0:ISC:") and got[5].n_found == 1 and got[5].findings.startswith("1:MIT:")


def test_licence_model_is_calibrated_and_quiet_without_its_words():
    model = licences.train()
    assert model.families[int(model.intercepts.argmax())] == "unknown"
    texts, classes = licences._examples(3, 2)
    number = {g: i for i, g in enumerate(model.features)}
    z = np.array([model.intercepts + sum((model.weights[number[g]] for g in licences.grams(t) if g in number), np.zeros(len(model.families))) for t in texts]) / model.temperature
    p = licences._softmax(z)
    assert (p.argmax(1) == classes).mean() > 0.95 and abs(p.max(1).mean() - (p.argmax(1) == classes).mean()) < 0.05


# 2


def brute_links(texts, least=0.8):
    sets = {}
    for k, t in texts.items():
        w = words(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links, root = dict.fromkeys(sets, 0), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both >= least * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (links[k], find(k)) for k in sets}


def near_copies(count, seed=0):
    rng = random.Random(seed)
    base = [f"t{rng.randrange(10_000)}" for _ in range(120)]
    out = {}
    for i in range(count):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10_000)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("block", [jaccard_join.BLOCK_SHINGLES, 700])
def test_jaccard_join(spark, texts, block):
    own = dict(list(texts.items())[:120]) | {100_000 + k: t for k, t in near_copies(25).items()}
    frame = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard_join.jaccard_join(frame, block_shingles=block).collect()}
    assert got == brute_links(own)


def test_a_round_of_components_has_a_small_plan_and_no_broadcast(spark):
    """What the driver holds grew with the plans: the edges stood in one more than 20 times, and small ones were broadcast in each join."""
    rng = random.Random(5)
    pairs = [(0, v) for v in range(1, 300)] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(400)]  # one node with many neighbours, and chains
    edges = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "u long, v long").repartition(3)
    one = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    plan = graph._small(graph._large(one))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("LogicalRDD") <= 4
    assert "Broadcast" not in plan.executedPlan().toString()
    root = {n: n for p in pairs for n in p}
    for _ in root:
        fell = False
        for u, v in pairs:
            low = min(root[u], root[v])
            fell |= root[u] != low or root[v] != low
            root[u] = root[v] = low
        if not fell:
            break
    assert {r["u"]: r["root"] for r in graph.components(edges).collect()} == {n: r for n, r in root.items() if n != r}


def test_recall_and_shortening():
    assert jaccard_join.shortened(0.8, 36, 10, 0.99999) == 5 and jaccard_join.recall(0.8, 36, 5) >= 0.99999 > jaccard_join.recall(0.8, 36, 6)


# 3


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = packing.pack(docs).collect()
    want = {}
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc_id, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= sum(r.length for r in got) / 2048 * 1.02 + 1


def test_best_fit_decreasing_is_exact():
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.choice([5, 17, 64])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        bins = []
        for x in sorted(items, reverse=True):
            fit = [(r, k) for k, r in enumerate(bins) if r >= x]
            if fit:
                bins[min(fit)[1]] -= x
            else:
                bins.append(capacity - x)
        counts = {x: items.count(x) for x in items}
        used = {}
        for x, n in counts.items():
            rows = [r for r in packing.best_fit_decreasing(counts, capacity).tolist() if r[0] == x]
            for k in range(n):
                r = max((r for r in rows if r[1] <= k), key=lambda r: r[1])
                used.setdefault(r[2] + (k - r[1]) // r[3], []).append((r[4] + (k - r[1]) % r[3] * x, x))
        assert sorted(capacity - sum(x for _, x in v) for v in used.values()) == sorted(bins)


TEXTS = ["", "don't we'll ''s 's 'S x'y i've 'l \"'s 1's", "«été» “x” été’s naïve", "i̇İ été ﬁ", "٣٤ x² ½", "a\0b", "<|endoftext|>a<|startoftext|>", "\x1c a \x1d", "日本語 テキスト", "ΑΣ ΣΑ", "x" * 100 + " " * 50, " a　b\xa0c", "\U0001f600 ͸֋ ok"]


def test_word_encoder_matches_the_library(texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own = TEXTS + list(texts.values())
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(own, add_special_tokens=False)]
    assert packing.WordEncoder(path, kept=500).encode(own) == want


# 4


def test_bpe_round_trip(docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in bpe.round_trip(docs).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.ByteBPE(path, kept=100)
    rng = random.Random(2)
    many = TEXTS + ["".join(rng.choice("aethsonr ") for _ in range(400)) for _ in range(60)] + ["ab" * 400]
    for text, ids in zip(many, own.encode(many), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


def test_pairs_are_compatible_just_when_merging_keeps_them():
    own = bpe.codec(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    ids = [i for i in own.id_of.values() if len(own.bytes_of[i]) < 6]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)]
    got = own.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [own.merge(own.bytes_of[a] + own.bytes_of[b]) == [a, b] for a, b in pairs]


def test_encode_decode_frames(spark, docs, texts):
    back = bpe.decode(bpe.encode(docs)).collect()
    assert {r.doc_id: r.text for r in back} == texts


# 5


def test_passages(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    exact, fuzzy, short = fresh(60), fresh(120), fresh(30)
    changed = [w if i % 12 else "new" for i, w in enumerate(fuzzy)]
    moved = fuzzy[:50] + fresh(3) + fuzzy[50:]
    rows = {0: fresh(40) + exact + fresh(40), 1: fresh(20) + exact + fresh(20), 2: fresh(10) + fuzzy + short + fresh(10), 3: changed + fresh(30), 4: fresh(80) + moved, 5: short + fresh(100), 6: fresh(200), 7: exact}
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    got = {(r.doc_id, r.other_doc_id): r for r in passages.passages(frame).collect()}
    assert set(got) == {(1, 0), (7, 0), (3, 2), (4, 2)}
    assert (got[1, 0].start, got[1, 0].end, got[1, 0].other_start, got[1, 0].other_end, got[1, 0].similarity) == (20, 80, 40, 100, 1.0)
    assert got[3, 2].end - got[3, 2].start >= 110 and got[3, 2].similarity > 0.88 and got[4, 2].end == 203
    left = {r.doc_id: r.text.split() for r in passages.drop_passages(frame).collect()}
    assert left[0] == rows[0] and left[1] == rows[1][:20] + rows[1][80:] and left[7] == [] and left[6] == rows[6]


def test_passages_whose_parts_occur_elsewhere(spark):
    """Parts of the passage stand in many earlier documents, the whole only in document 2000."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, often = fresh(60), fresh(55)
    rows = {1: fresh(30) + shared[:40] + fresh(30), 2: fresh(9) + shared + fresh(20), 3: fresh(25) + shared + fresh(12)}
    rows |= {100 + i: fresh(20) + often[5 * (i % 6) : 5 * (i % 6) + 30] + fresh(20) for i in range(60)}
    rows |= {2000: fresh(30) + often + fresh(8), 2001: fresh(5) + often + fresh(30)}
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    got = {(r.doc_id, r.other_doc_id): (r.start, r.end) for r in passages.passages(frame).collect()}
    assert got == {(3, 2): (25, 85), (2001, 2000): (5, 60)}
    left = {r.doc_id: r.text.split() for r in passages.drop_passages(frame).collect()}
    assert left[3] == rows[3][:25] + rows[3][85:] and left[2001] == rows[2001][:5] + rows[2001][60:] and left[2] == rows[2]


def test_texts_meet_their_groups_alike_at_any_size(spark, monkeypatch):
    """A few groups are not broadcast to the texts, so what is shuffled grows as the texts do."""
    plans, write = {}, jaccard_join.materialize

    def record(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(jaccard_join, "materialize", record)
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(i, f"{text} x{i // 2}") for i in range(6)], "doc_id long, text string")
    assert {r.class_id for r in jaccard_join.jaccard_join(frame).collect()} == {0}
    assert "SortMergeJoin [uid" in plans["found"] and "BroadcastHashJoin [uid" not in plans["found"]


def by_windows(texts, size=50):
    """By document the words that lie in a run of `size` words which an earlier document has too."""
    first, out = {}, {}
    for k in sorted(texts):
        w = words(texts[k])
        held = set()
        for i in range(len(w) - size + 1):
            if first.setdefault(tuple(w[i : i + size]), k) != k:
                held.update(range(i, i + size))
        out[k] = held
    return out


def fragments():
    """Documents whose passages are spread over others in parts: see the names."""
    rng = random.Random(16)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = {}
    put = lambda *parts: rows.setdefault(len(rows), [w for p in parts for w in p])
    quarters = fresh(80)
    for i in range(4):  # four documents hold a quarter each, two the whole
        put(fresh(9), quarters[20 * i : 20 * i + 20], fresh(30))
    put(fresh(10), quarters, fresh(20))
    put(fresh(30), quarters, fresh(6))
    lines, whole = [fresh(9) for _ in range(12)], fresh(52)
    for _ in range(40):  # frequent lines in any order, and a part of `whole`
        at = rng.randrange(20)
        put(*rng.sample(lines, 5), fresh(20), whole[at : at + 32], *rng.sample(lines, 3))
    order = [lines[i] for i in (3, 1, 4, 1, 5, 9, 2)]
    put(fresh(12), *order, fresh(3), whole)
    put(fresh(4), *order, fresh(7), whole, fresh(60))
    put(["the"] * 300, fresh(5))
    put(fresh(5), ["the"] * 700)
    put(*[fresh(1) + lines[0]] * 1, ["the"] * 60, *[lines[0]] * 8)
    put(fresh(50), *[lines[0]] * 9, fresh(50))
    for _ in range(30):  # one passage in many documents, more of them than a batch ties alone
        put(fresh(3), whole, fresh(4), quarters[10:64])
    return {k: " ".join(v) for k, v in rows.items()}


@pytest.mark.parametrize("case", ["fragments", "0.001", "0.01"])
def test_no_exact_passage_is_missed(spark, case):
    """Every word of 50 in a row that an earlier document has too is in a passage, and every passage is what it says."""
    texts = fragments() if case == "fragments" else {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/sf{case}/documents.parquet").collect()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = passages.passages(frame).collect()
    held, split = {k: set() for k in texts}, {k: words(t) for k, t in texts.items()}
    for r in got:
        assert r.other_doc_id < r.doc_id and r.end - r.start >= 50 and r.similarity >= 0.8 - 1e-9
        if r.similarity == 1:
            assert split[r.doc_id][r.start : r.end] == split[r.other_doc_id][r.other_start : r.other_end]
        held[r.doc_id].update(range(r.start, r.end))
    wanted = by_windows(texts)
    assert sum(map(len, wanted.values())) > 500
    assert {k: w - held[k] for k, w in wanted.items() if w - held[k]} == {}


def test_seeds_are_shared_and_surrounded():
    """Texts that share 21 words in a row share a seed there; no k-mer of small hash lies whole in the surroundings of a seed but itself."""
    rng = random.Random(3)
    for _ in range(200):
        common = [f"w{rng.randrange(30)}" for _ in range(21)]
        two = [" ".join([f"x{rng.randrange(9)}" for _ in range(rng.randrange(40))] + common + [f"y{rng.randrange(9)}" for _ in range(40)]) for _ in range(2)]
        value, text, pos, _, near = passages.seeds(W.Words(two), 5, 16, 0.25, 20)
        at = [t.split().index(common[0]) for t in two]
        where = [{(v, p - a) for v, t, p in zip(value, text, pos, strict=True) if t == i and a <= p <= a + 15} for i, a in enumerate(at)]
        assert where[0] & where[1]
        low, high, small = pos - (near & (2**31 - 1)), pos + ((near >> 31) & (2**31 - 1)), near >> 62
        for i in range(len(value)):
            inside = [j for j in range(len(value)) if text[j] == text[i] and small[j] and low[i] <= pos[j] and pos[j] + 6 <= high[i]]
            assert inside == ([i] if small[i] else [])


def test_contexts_never_rule_a_passage_out():
    rng = np.random.default_rng(2)
    for _ in range(300):
        size, at = 50, int(rng.integers(0, 45))
        one = rng.integers(0, 2**63, 200).astype(np.uint64)
        two = rng.integers(0, 2**63, 200).astype(np.uint64)
        two[70 : 70 + size] = one[70 : 70 + size]
        wrong = rng.choice([i for i in range(size) if not at <= i < at + 6], 10, replace=False)
        two[70 + wrong] = rng.integers(0, 2**63, 10).astype(np.uint64)
        place = np.array([70 + at])
        assert passages.allowed(passages.contexts(one, place, 6) ^ passages.contexts(two, place, 6), 6, size, 0.8).all()
    apart = rng.integers(0, 2**63, 2000).astype(np.uint64)
    assert passages.allowed(apart, 6, 50, 0.8).mean() < 0.1


def test_ties_connect_all_texts_of_a_seed():
    rng = np.random.default_rng(4)
    for _ in range(100):
        seed, uid = np.sort(rng.integers(0, 5, 60)), rng.integers(0, 12, 60)
        order = np.lexsort((uid, seed))
        seed, uid = seed[order], uid[order]
        later, earlier, over, outer = passages.tied(seed, uid)
        assert (seed[later] == seed[earlier]).all() and (uid[earlier] < uid[later]).all() and len(later) <= 4 * 60
        for s in set(seed):
            own = sorted(set(uid[seed == s]))
            ties = {(a, b) for a, b, c in zip(uid[later], uid[earlier], seed[later], strict=True) if c == s}
            for i, u in enumerate(own):
                assert {b for a, b in ties if a == u} == set(own[: min(i, 2)]) | set(own[max(i - 2, 0) : i])
                assert outer[(seed == s) & (uid == u)].all() == (i < 2 or i >= len(own) - 2)
            repeats = len(own) > 1 and (seed == s).sum() > len(own)
            assert over[seed == s].all() == over[seed == s].any() == (len(own) > 5 or repeats)


def test_every_fifth_word_changed(spark):
    """At 0.8 with changes at regular places there are no five words in a row: the spaced seeds find them."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = {}
    for k in range(0, 200, 2):
        one = fresh(120)
        rows |= {k: fresh(20) + one + fresh(20), k + 1: fresh(30) + [w if i % 5 != 2 else "x" + w for i, w in enumerate(one)]}
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    assert len({r.doc_id for r in passages.passages(frame).collect()}) >= 95


def test_stretches_find_what_is_just_similar_enough():
    rng = np.random.default_rng(7)
    assert passages.stretches(np.array([True, False] + [True] * 48), 0.8, 50) == [(0, 50)]
    for _ in range(300):
        same = rng.random(90) < rng.choice([0.7, 0.8, 0.9])
        total = np.concatenate([[0], np.cumsum(same)])
        ends = np.flatnonzero(same)
        some = any(j + 1 - i >= 50 and total[j + 1] - total[i] >= 0.8 * (j + 1 - i) for i in ends for j in ends)
        got = passages.stretches(same, 0.8, 50)
        assert bool(got) == some and all(t - s >= 50 and same[s:t].mean() >= 0.8 - 1e-9 for s, t in got)


def test_recall_of_passages(spark):
    """Planted passages with words replaced at random, by length and share left alike: at least 95 in 100 are found, at 0.9 at least 99. One that begins or ends with replaced words, and so is under 50 words by its agreeing ends, is not counted."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, cases = {}, {}
    for size, share in itertools.product((50, 60, 100), (0.8, 0.85, 0.9)):
        for _ in range(100):
            one = fresh(size)
            two = list(one)
            for i in rng.sample(range(1, size - 1), round(size * (1 - share))):
                two[i] = fresh(1)[0]
            k = 2 * len(cases)
            rows |= {k: fresh(30) + one + fresh(30), k + 1: fresh(17) + two + fresh(40)}
            cases[k + 1] = (k, share)
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    found = {(r.doc_id, r.other_doc_id) for r in passages.passages(frame).collect()}
    assert found <= {(k, other) for k, (other, _) in cases.items()}
    for share, least in ((0.8, 0.95), (0.85, 0.95), (0.9, 0.99)):
        own = [(k, other) in found for k, (other, s) in cases.items() if s == share]
        print(share, np.mean(own))
        assert np.mean(own) >= least


def test_similar_passages_whose_seeds_are_frequent(spark):
    """A changed copy is met though each of its words stands in many other documents before it and between, in pieces too short for a passage."""
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    plain, mixed = [], []
    for i in range(40):
        base, body = 1000 * i, words(60)
        changed = [x if rng.random() >= (0.05, 0.1, 0.15)[i % 3] else f"z{j}" for j, x in enumerate(body)]
        whole = [(base + 100, " ".join(words(80) + body + words(80))), (base + 500, " ".join(words(80) + changed + words(80)))]
        pieces = [(base + s + 2 * t + u, " ".join(words(60) + body[10 * t : 10 * t + 20] + words(60))) for s in (0, 200, 300) for t in range(5) for u in range(2)]
        plain += whole
        mixed += whole + pieces
    of = lambda rows: {(r.doc_id, r.other_doc_id) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    expected, got = of(plain), of(mixed)
    assert len(expected) >= 36
    assert expected <= got


@pytest.mark.parametrize("pairs", [1 << 18, 8])
def test_meetings_leave_no_word_that_a_stretch_holds(monkeypatch, pairs):
    """Against all pairs of occurrences: their ties reach each bare word that any pair's stretches reach, at most as many ties as bare words."""
    monkeypatch.setattr(passages, "PAIRS", pairs)  # lists of pairs, and blocks of many
    rng = np.random.default_rng(3)
    for size, share in ((10, 0.8), (12, 0.6)):
        n, width = 200, 25
        group, uid = np.sort(rng.integers(0, 6, n)) * 7, np.zeros(n, np.int64)
        for g in np.unique(group):
            uid[group == g] = np.sort(rng.integers(0, 30, (group == g).sum()))
        words = rng.integers(1, 4, (n, width)).astype(np.uint8)
        kin = rng.integers(0, n, n)
        words[: n // 2] = np.where(rng.random((n // 2, width)) < 0.8, words[kin[: n // 2]], words[: n // 2])
        words[rng.random(n) < 0.2, -4:] = 0
        words[5::9] = words[4::9][: len(words[5::9])]
        bare = (rng.random((n, width)) < 0.3) & (words > 0) & (rng.random(n) < 0.7)[:, None]
        met = rng.random(n) < 0.9
        i, j = passages.Meeting(group, uid, words, bare, met, size, share).ties()

        def held(a: int, b: int) -> np.ndarray:
            same, inside = words[a] == words[b], (words[a] > 0) & (words[b] > 0)  # noqa: B023
            out = np.zeros(width, bool)  # noqa: B023
            for s, t in itertools.combinations(range(width + 1), 2):  # noqa: B023
                if t - s >= size and same[s:t].sum() >= share * (t - s) - 1e-9 and inside[s:t].all():  # noqa: B023
                    out[s:t] = True
            return out

        for a in range(n):
            others = np.flatnonzero((group == group[a]) & (uid < uid[a]) & met)
            want = np.any([np.zeros(width, bool), *(held(a, b) for b in others)], axis=0)
            mine = j[i == a]
            assert np.isin(mine, others).all() and len(mine) <= bare[a].sum()
            have = np.any([np.zeros(width, bool), *(held(a, b) for b in mine)], axis=0)
            assert (have & bare[a] == want & bare[a]).all()


def test_chains_are_optimal():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 7)
        a, b, m = ([rng.randint(0, 40) for _ in range(n)] for _ in range(2)), None, None
        a, b = a
        m = [rng.randint(1, 8) for _ in range(n)]
        best = 0
        for size in range(1, n + 1):
            for path in itertools.permutations(range(n), size):
                if all(a[i] + m[i] <= a[j] and b[i] + m[i] <= b[j] for i, j in itertools.pairwise(path)):
                    best = max(best, sum(m[i] for i in path) - passages.GAP_COST * sum(a[j] - a[i] - m[i] + b[j] - b[i] - m[i] for i, j in itertools.pairwise(path)))
        first = passages.chain(a, b, m)[0]
        score = sum(m[i] for i in first) - passages.GAP_COST * sum(a[j] - a[i] - m[i] + b[j] - b[i] - m[i] for i, j in itertools.pairwise(first))
        assert score == pytest.approx(best)


def test_word_offsets():
    for text in ("Ab, cd_9 é-f", "İx İy", ""):
        start, end = passages.word_offsets(text)
        assert [text[i:j].lower() for i, j in zip(start, end, strict=True)] == words(text)


# 6


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all() and (got.predicted == got.quality)[got.held_out].mean() > 0.95


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = [rng.normal(k, 1 + k, (4000, d)) for k in (0, 1)]
    model = quality.Discriminant([(len(v), v.sum(0), v.T @ v) for v in x], 1e-9, 1e-9)
    at = rng.normal(0.5, 1, (50, d))
    want = [sum(-0.5 * ((at - v.mean(0)) @ np.linalg.inv(np.cov(v.T, bias=True)) * (at - v.mean(0))).sum(1) * s - s * 0.5 * np.linalg.slogdet(np.cov(v.T, bias=True))[1] for s, v in ((1, x[1]), (-1, x[0])))]
    assert np.allclose(np.sinh(model.difference(at)), want[0], rtol=1e-4, atol=1e-3)


# 7


def brute_signature(text, tool):
    own = text.split()
    k = tool.k
    hashes = dict(zip(own, fingerprint.W.Words([" ".join(own)], fingerprint.W.NOT_SPACE, fold=False).hash.tolist(), strict=True)) if own else {}
    grams = [tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))] if own else []
    mix = lambda v: int(fingerprint.W.mix(np.array([v % 2**64], np.uint64))[0])
    values, seen, numbered = [], {}, []
    for g in grams:
        v = 0
        for w in g:
            v = mix(v * 3 + hashes[w])
        values.append(v)
        numbered.append(mix(v + seen.get(v, 0) * 0xD1342543DE82EF95))
        seen[v] = seen.get(v, 0) + 1
    out = []
    for a, b in zip(*[f.tolist() for f in tool.family], strict=True):
        if not values:
            out.append(0)
            continue
        ranked = sorted((((h * a + b) % 2**64) >> 22, i) for i, h in enumerate(numbered))[:2]
        first, *rest = sorted(i for _, i in ranked)
        out.append(mix(values[first] * 3 + mix(values[rest[0] if rest else first])) >> 48)
    return out


def test_order_minhash(docs, texts):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    tool = fingerprint.OrderMinHash()
    order = sorted(texts, reverse=True)
    for i, doc_id in enumerate(order):
        text, following = texts[doc_id], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        if i < 12:
            own, other, after = brute_signature(text, tool), brute_signature(new, tool), brute_signature(following, tool)
            assert r.fingerprint == fingerprint.text_of(np.array([own], np.uint16))[0] and r.edited_fingerprint == fingerprint.text_of(np.array([other], np.uint16))[0]
            assert r.near_edited == np.mean(np.equal(own, other)) and r.near_next == np.mean(np.equal(own, after))


def test_texts_longer_than_the_low_bits_hold():
    """Places apart from hashes give what places in their low bits give; and a text of five million words has two k-mers a slot."""
    rng = np.random.default_rng(6)
    counts = np.array([1, 2, 3, 500, 40_000])
    starts = np.cumsum(counts) - counts
    value = rng.integers(0, 1 << 63, counts.sum()).astype(np.uint64) >> np.uint64(20) << np.uint64(22)
    places = np.concatenate([np.arange(n) for n in counts]).astype(np.uint64)
    one, two = fingerprint.two_least(value.copy(), starts, counts, places), fingerprint.two_least(value.copy(), starts, counts, None)
    assert (one[0] == two[0]).all() and (one[1] == two[1])[1:].all()
    tool = fingerprint.OrderMinHash(slots=2)
    tail = " ".join(f"v{i}" for i in range(800_000))
    long = " ".join(map(str, range(4_300_000))) + " "
    a, b = tool.signatures([long + tail]), tool.signatures([long + tail])
    assert (a == b).all() and len(set(a[0])) == 2


def test_unspaced_scripts_have_a_word_a_character():
    tool = fingerprint.OrderMinHash()
    text = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(700))
    one, two = tool.signatures([text, text + "。"])
    assert (one == two).mean() > 0.9


def test_order_matters():
    tool = fingerprint.OrderMinHash(256)
    base = [f"w{i}" for i in range(200)]
    a, swapped, edited = tool.signatures([" ".join(base), " ".join(base[100:] + base[:100]), " ".join(base[:190] + [f"x{i}" for i in range(10)])])
    assert (a == edited).mean() > (a == swapped).mean() + 0.15


# 8


def brute_base(text):
    import regex

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in regex.finditer(pattern, text):
            digits = regex.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark, docs):
    rng = random.Random(6)
    parts = ["a@b.c", ".", "@", "_", "x", "1", "22", "255", "256", ".", "+", "-", " ", "4539578763621486", "(", "é", "𝒳", "\n", "4111 1111 1111 1111", "+1 (386) 555-3733", "1.2.3.4"]
    own = [(10**6 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(1, "9" * 20_000 + "a" * 20_000 + "@"), (2, "a@b.co" * 500)]
    frame = spark.createDataFrame(own, "doc_id long, text string")
    for r, text in zip(pii.find(frame).orderBy("doc_id").collect(), [t for _, t in sorted(own)], strict=True):
        want = ",".join(brute_base(text))
        base = ",".join(x for x in r.spans.split(",") if not x.startswith("term:"))  # the method may add terms
        assert (base, r.base_sha256) == (want, hashlib.sha256(want.encode()).hexdigest())


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} written by zorblat using mail joe@x.org on day{i} for all people") for i in range(6)] + [(100 + i, f"some other words for all people number {i}") for i in range(200)] + [(900, "a page of Zorblat alone")]
    rows += [(1000 + i, "note one written by quixot using mail amy@x.org for all people") for i in range(9)]  # copies prove nothing
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    assert got[0].n_email == 1 and "term" in got[0].spans and got[0].n_term >= 1
    text = rows[-10][1]
    start = text.index("Zorblat")
    assert got[900].spans == f"term:{start}:{start + 7}" and got[1000].n_term == 0 and got[100].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "joe@x.org" not in clean[0] and "zorblat" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[6][1] and clean[900] == "a page of [TERM] alone"


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_terms_are_found_in_the_tables(spark, sf):
    """The values there are seen in one document or two; terms are words by them, and documents without a value or such a term have no span."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    got = pii.find(docs).collect()
    some = [r for r in got if r.n_term]
    assert some and sum(r.n_term for r in some) < 20 * sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    assert sum(r.n_term > 0 and r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in got) <= 0.01 * len(got)


def test_terms_of_rare_values(spark):
    """A value seen in two documents has terms, among them a name of two letters and an identifier; one copied text proves nothing."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"c{rng.randrange(300)}" for _ in range(n))
    rows = [(i, fresh(12)) for i in range(20_000)]
    for i in range(2):
        rows.append((30_000 + i, f"{fresh(3)} Bo wrote unit77 {fresh(2)} bo.x@mail.example {fresh(4)}"))
        rows.append((40_000 + i, "here stands copied99 with cy@mail.example once"))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).filter("doc_id >= 30000").collect()}
    text = dict(rows)[30_000]
    spans = [text[int(a) : int(b)] for kind, a, b in (x.split(":") for x in got[30_000].spans.split(",")) if kind == "term"]
    assert {"Bo", "unit77"} <= set(spans) and not any(x.startswith("c") for x in spans)
    assert got[30_000].n_email == 1 and got[30_000].n_term >= 2 and got[40_000].n_term == 0


# 9


def test_neighbours(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()]
    rows += [(10_000, rows[0][1]), (10_001, rows[0][1]), (10_020, [0.0] * 64), (10_040, None), (10_060, [float("nan")] * 64), (None, rows[1][1]), (10_080, [1.0, 2.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    hits = 0
    queries = [i for i in ids if i % 20 == 0]
    for q in queries:
        score = (x * good[q]).sum(1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own.score, [(good[q] * good[i]).sum() for i in own.vec_id], atol=1e-12)
        assert list(zip(-own.score, own.vec_id, strict=True)) == sorted(zip(-own.score, own.vec_id, strict=True))
        hits += len(set(best) & set(own.vec_id))
    assert set(got.query_id) == set(queries) and hits / (20 * len(queries)) >= 0.9
    assert got[got.query_id == 0].vec_id.tolist()[:2] == [10_000, 10_001]


def test_rows_of_one_vec_id_are_rows_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(20 * (i // 2), rng.normal(size=8).tolist()) for i in range(12)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 12 * 11 and {r["rank"] for r in got} == set(range(1, 12))
    assert sorted((r.query_id, r.vec_id) for r in got) == sorted((rows[i][0], rows[j][0]) for i in range(12) for j in range(12) if i != j)


def test_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 4), np.uint16)
    codes[100:140] = codes[0] ^ rng.integers(0, 4, (40, 4)).astype(np.uint16)
    index = neighbours.Index(codes)
    for radius in (0, 3, 7, 20, 31):
        for q in (0, 120, 300):
            apart = np.bitwise_count(codes ^ codes[q]).sum(1)
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


# 10


def brute_grams(text):
    out = {}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f"_{w}_"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != "_":
                    out[g] = out.get(g, 0) + 1
    return out


def test_language(docs, texts):
    own = list(texts.values())[:20]
    gram, where = language.grams(own)
    for i, text in enumerate(own):
        spelt = {}
        for g in gram[where == i].tolist():
            parts, n = [], g
            while n:
                parts.append(n & (1 << 21) - 1)
                n >>= 21
            s = "".join(chr(c) if c else "_" for c in reversed(parts))
            spelt[s] = spelt.get(s, 0) + 1
        want = {}
        for g, n in brute_grams(text).items():
            want[g.lstrip("_") if g.startswith("_") else g] = want.get(g.lstrip("_") if g.startswith("_") else g, 0) + n
        lead = {}
        for g, n in spelt.items():
            lead[g] = n
        assert sum(spelt.values()) == sum(brute_grams(text).values()) and lead == want
    langs = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95


def test_out_of_place_distance():
    p = language.Profiles({"b": [1, 2, 3], "a": [3, 2, 1]}, 3)
    assert p.nearest(np.array([1, 2, 3])) == ("b", 1.0) and p.nearest(np.array([2])) == ("a", 0.0) and p.nearest(np.array([9]))[1] == 0.0


# odd rows


OPERATORS = {
    "licences": lambda d: licences.scan(d), "jaccard": lambda d: jaccard_join.jaccard_join(d), "packing": lambda d: packing.pack(d), "bpe": lambda d: bpe.round_trip(d), "passages": lambda d: passages.passages(d),
    "quality": lambda d: quality.classify(d, d.sparkSession.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (5, 7)], "doc_id long, quality int")), "fingerprints": lambda d: fingerprint.fingerprints(d), "pii": lambda d: pii.find(d), "language": lambda d: language.identify(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd).collect()
    if name == "passages":
        assert got == []
    elif name == "packing":
        assert len(got) > 11 and sum(r.piece == 0 for r in got) == 11
    else:
        assert len(got) == 11
    if name == "jaccard":
        assert sorted((r.doc_id, r.n_links, r.class_id) for r in got if r.doc_id in (1, 7)) == [(1, 2, 1), (1, 2, 1), (7, 2, 1)]
    if name == "language":
        assert {r.lang_pred for r in got if r.doc_id in (2, 3, 6)} == {"und"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(empty, name):
    frame = OPERATORS[name](empty)
    assert frame.collect() == [] and frame.columns


def test_neighbours_of_nothing(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
