import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readlog.llm import binary_packing, bwt, exchange, language_id, mixing, near_dedup, packing, quality_model, quality_rules, search, substring_dedup, suffix_dedup, textnum
from readlog.llm.components import components
from readlog.llm.tokens import encoder
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, blk int, _row long, _id int, rank int, bands int, kept string"
SF = "/root/testdata/sf0.001"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def edge_rows():
    a, b = words(1, 300), words(2, 120)
    w = a.split()
    texts = [
        None, "", "   \n\t", "one", "Four words stand here", a, a, a.upper(), " ".join(w[:150] + ["CHANGED"] + w[150:]), " ".join(w[40:110]), b + " " + " ".join(w[100:180]),
        "x " * 500, "la " * 60 + b, "# $ % & | < > word", "Äther über  alles – «ça» naïve", "a" * 30_000, "line one here\nline one here\nline two here\nline one here", "<|endoftext|> is text", words(3, 4000), b, "two  spaces   and\n\n lines \n x",
    ]
    rows = [(i * 3 + 1, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (7, words(4, 90), "en", "s1"), (None, a, None, "s0"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), 9, "z", 3, 4, 5, 6, 7, "q") for r in rows]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(r[0], r[1]) for r in edge_rows()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_empty_tables(spark, nothing):
    frames = [
        quality_rules.judge(nothing), quality_rules.apply_rules(nothing), mixing.mix(nothing), mixing.apply_mix(nothing), packing.binary_pieces(nothing), binary_packing.packed_rows(nothing), near_dedup.near_duplicates(nothing), near_dedup.keep_one(nothing),
        substring_dedup.dedup(nothing), substring_dedup.remove_repeats(nothing), suffix_dedup.dedup(nothing), search.search(nothing, nothing.select(F.col("doc_id").alias("query_id"), "text")), language_id.predict(nothing, *language_id.fit(nothing)),
        quality_model.predict(nothing, quality_model.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"))),
    ]
    for df in frames:
        assert df.collect() == []


# quality rules
def counts(text):
    w, t = brute.WORD.findall(text or ""), text or ""
    lines = [x for x in t.split("\n") if brute.WORD.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))


def test_quality_rules(edges):
    got = quality_rules.judge(edges).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(d, *(c := counts(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for d, t in pairs()]
    assert ordered(got) == ordered(want)
    kept = quality_rules.apply_rules(edges)
    assert kept.columns == edges.columns
    assert kept.count() == quality_rules.judge(edges).filter("kept").count()


# mixing
def test_sainte_lague_is_highest_quotients(spark):
    r = random.Random(5)
    for trial in range(6):
        weights = {f"c{i:02}": r.choice([1, 3, 50, 1000]) * r.random() for i in range(r.randint(1, 30))}
        seats = r.randint(0, 200)
        got = mixing.sainte_lague(spark.createDataFrame([("g", k, v, seats) for k, v in weights.items()], "g string, k string, w double, s long"), "g", "k", "w", "s").collect()
        won = dict.fromkeys(weights, 0)
        heap = [(-v, k) for k, v in weights.items()]
        heapq.heapify(heap)
        for _ in range(seats):
            _, k = heapq.heappop(heap)
            won[k] += 1
            heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), k))
        assert {x["k"]: x["won"] for x in got} == won, trial


def fill(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[n] for n in full)
        open_ = [n for n in names if n not in full]
        target = {n: 2.0 * sizes[n] for n in full} | {n: rest * weight[n] / sum(weight[x] for x in open_) for n in open_}
        over = [n for n in open_ if target[n] > 2 * sizes[n]]
        if not over:
            return target
        full |= set(over)


@pytest.mark.parametrize("shard", [1_000_000, 200])
def test_mixing(edges, shard, monkeypatch):
    rows = mixing.mix(edges, shard_words=shard).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((d or -1, len(brute.WORD.findall(t or ""))) for d, t in pairs())
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(fill(size))
    cells = 1 if shard > 10_000 else 40
    assert all(abs(taken[s] - target[s]) <= 16 * cells for s in size)
    assert ordered(mixing.mix(edges, shard_words=shard).collect()) == ordered(rows)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert ordered(mixing.mix(edges, shard_words=shard).collect()) == ordered(rows)
    mixed = mixing.apply_mix(edges)
    assert mixed.columns == edges.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(mixing.mix(edges).select("taken").toPandas()["taken"])


# packing
def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers_own():
    t, encode, r = hf(), encoder(), random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "1", "\u00a0", "\u3000", "!", "日", "'", "\r\n", "\x85", "\x1c", "\u200b", "<|endoftext|>", "<|endo"]
    texts = [x or "" for _, x in pairs()] + ["".join(r.choice(parts) for _ in range(60)) for _ in range(400)]
    texts += ["<|endoftext|>", " <|endoftext|> ", "a<|endoftext|>b", "x  <|endoftext|>\n\n<|endoftext|> y"]
    for x in texts:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x
    assert 50256 in np.frombuffer(encode("a<|endoftext|>b"), "<u4")


def test_binary_pieces(edges):
    rows = packing.binary_pieces(edges).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0 and r["length"] == 1 << r["bucket"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    by = Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in rows)
    t, want = hf(), Counter()
    for d, x in pairs():
        ids, at = [*t.encode(x or "", add_special_tokens=False).ids, 0], 0
        for n in packing.piece_lengths(len(ids)):
            want[(d, at, n, np.array(ids[at : at + n], "<u4").tobytes(), len(ids))] += 1
            at += n
        assert at == len(ids)
    assert by == want


def test_written_buckets(spark, edges, tmp_path):
    pieces = packing.binary_pieces(edges).cache()
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    key = lambda df: Counter((r["doc_id"], r["start"], r["bucket"], r["length"], bytes(r["ids"])) for r in df.collect())
    assert key(back) == key(pieces)
    assert {p.name for p in (tmp_path / "buckets").iterdir() if p.is_dir()} == {f"bucket={r['bucket']}" for r in pieces.select("bucket").distinct().collect()}


def test_best_fit_decreasing():
    r = random.Random(9)
    for _ in range(30):
        capacity = r.choice([7, 64, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        rows = binary_packing.best_fit_decreasing(lengths, capacity)
        free: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(capacity - n)
        assert len(rows) == len(free) and sorted(capacity - sum(lengths[i] for i in x) for x in rows) == sorted(free)
        assert sorted(i for x in rows for i in x) == list(range(len(lengths)))


def test_packed_rows_round_trip(edges, tmp_path):
    parts, t = {}, hf()
    written = binary_packing.write_rows(binary_packing.packed_rows(edges, capacity=64, lot=1500), str(tmp_path / "rows"))
    for r in written.collect():
        ids, positions, bounds = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 64 and bounds[-1] == r["n_tokens"]
        for d, start, a, b in zip(r["doc_ids"], r["starts"], bounds, bounds[1:], strict=False):
            parts.setdefault(d, []).append((start, ids[a:b].tolist()))
            assert positions[a:b].tolist() == list(range(b - a))
    want: dict = {}
    for d, x in pairs():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 50256]
        want.setdefault(d, []).extend((i, ids[i : i + 64]) for i in range(0, len(ids), 64))
    assert {d: sorted(v) for d, v in parts.items()} == {d: sorted(v) for d, v in want.items()}


# deduplication
@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "bucket_bytes": 2000}])
def test_substring_dedup(edges, sizes):
    assert ordered(substring_dedup.dedup(edges, **sizes).collect()) == ordered(brute.repeats_by_word(pairs()))


def passages():
    """One passage in a third of the documents, twice in some; documents that repeat themselves, and rows that share an id."""
    r = random.Random(9)
    hot, own = words(81, 70), words(82, 65)
    rows = []
    for i in range(150):
        text = [words(1000 + i, r.randint(5, 40))]
        if i % 3 == 0:
            text.append(hot if i % 2 else hot.replace("a", "q", i % 5))
        if i % 10 == 0:
            text += [words(3000 + i, 12), hot]
        if i % 25 == 7:
            text += [own, "x", own, words(4000 + i, 7), own]
        rows.append((i // 2 if i % 30 in (6, 7) else 500 - i, " ".join(text)))
    return rows + [(900, "la " * 300), (901, "la " * 200), (900, "la " * 120), (None, hot), (None, own + " " + own), (None, own)]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 6000, "bucket_bytes": 3000}])
def test_passages_that_many_documents_share(spark, sizes):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ordered(substring_dedup.dedup(docs, **sizes).collect()) == ordered(brute.repeats_by_word(rows))
    assert ordered(suffix_dedup.dedup(docs, **sizes).collect()) == ordered(brute.repeats_by_byte(rows))
    assert ordered(suffix_dedup.dedup(docs, hot_strings=2, **sizes).collect()) == ordered(brute.repeats_by_byte(rows))


def test_a_block_sends_a_passage_once():
    """A passage in 3,333 of 10,000 documents: its windows are one entry each, with the smallest id."""
    hot = words(81, 60)
    table = pa.table({"doc_id": pa.array(range(10_000), pa.int64()), "text": pa.array([f"{'ab'[i % 2]}{i} {hot} c{i}" if i % 3 == 1 else f"d{i} e{i}" for i in range(10_000)])})
    block = exchange.Block.of(table)
    live = list(substring_dedup.live_values([(0, data) for _, data in substring_dedup.probes(block, exchange.Plan(1, 1), 25)]))
    sent = [exchange.unpack(data, np.uint64, np.uint32, np.int64, *[np.uint32] * 4) for _, data in substring_dedup.candidates(block, [(0, d) for _, d in live], exchange.Plan(1, 1), 50, 25)]
    entries = [int(x[3].sum()) for x in sent]
    assert sum(entries) == sum(len(x[0]) for x in sent) == len({v for x in sent for v in x[0].tolist()}) <= 11 + 2 * 3333
    assert sum(len(x[4]) for x in sent) == 11 * 3332  # decided here


def test_substring_removal_keeps_columns(edges):
    rows = edges.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    want = {x[0]: x for x in brute.repeats_by_word(list(texts.items()))}
    out = substring_dedup.remove_repeats(rows)
    assert out.columns == edges.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for d, (_, n, gone, digest) in want.items():
        if gone == 0:
            assert got[d] == texts[d]
        elif gone == n:
            assert d not in got
        else:
            assert hashlib.sha256(got[d].encode()).hexdigest() == digest


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "bucket_bytes": 2000, "batch": 500}, {"block_bytes": 3000, "hot_strings": 1}])
def test_suffix_dedup(edges, sizes):
    assert ordered(suffix_dedup.dedup(edges, **sizes).collect()) == ordered(brute.repeats_by_byte(pairs()))


def test_merged_transforms_give_common_minima():
    r = np.random.default_rng(4)
    for alphabet in (2, 4, 256):
        for depth in (5, 8, 50):
            base = r.integers(0, alphabet, 400).astype(np.uint8)
            strings = [base[a : a + n] for a, n in zip(r.integers(0, 250, 60), r.integers(1, 120, 60), strict=True)]
            value = r.permutation(60).astype(np.int64)
            least: dict = {}
            for s, v in zip(strings, value.tolist(), strict=True):
                for i in range(len(s) - depth + 1):
                    k = s[i : i + depth].tobytes()
                    least[k] = min(least.get(k, v), v)
            want = [least[s[i : i + depth].tobytes()] for s in strings for i in range(len(s) - depth + 1)]
            assert bwt.common_minimum(np.concatenate(strings), np.array([len(s) for s in strings]), value, depth).tolist() == want


def test_sorted_suffixes():
    data = np.frombuffer(b"bananabandanaban", np.uint8)
    codes, bits = bwt.encode(data, np.array([6, 7, 3]))
    text, ends = codes.tolist(), [6, 14, 18]
    key = lambda i: [*text[i : (e := next(x for x in ends if x >= i))], -len(text) + e]
    assert bwt.sort_suffixes(codes, bits).tolist() == sorted(range(len(text)), key=key)


@pytest.mark.parametrize("group", [4_000_000, 200])
def test_near_duplicates(spark, group):
    base = words(11, 200).split()
    r = random.Random(6)
    rows = [(i, " ".join(w if r.random() > 0.01 * (i % 4) else w + "x" for w in base)) for i in range(60)]
    rows += [(100 + d, t) for d, t in pairs() if d is not None]
    unique = list(dict(rows).items())
    docs = spark.createDataFrame(unique, "doc_id long, text string").withColumn("kept", F.lit("z"))
    assert ordered(near_dedup.near_duplicates(docs, group).collect()) == ordered(brute.near_classes(unique))


@pytest.mark.parametrize("group", [near_dedup.GROUP_SHINGLES, 300])
def test_near_duplicates_keep_links_of_rows_that_share_an_id(spark, group):
    near = lambda t, k: " ".join(w if i != k else "other" for i, w in enumerate(t.split()))
    x, y, z = words(71, 120), words(72, 120), words(73, 120)
    rows = [(1, x), (7, near(x, 60)), (7, y), (9, near(y, 50)), (9, near(y, 50)), (5, z), (5, near(z, 3)), (5, z.upper()), (12, y), (3, None), (3, ""), (3, "few words"), (4, "few words"), (3, z)]
    rows += [(20 + i, near(x, i)) for i in range(0, 30, 3)] + [(7, near(z, 100)), (7, words(74, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = ordered(brute.near_classes(rows))
    assert ordered(near_dedup.near_duplicates(docs, group).collect()) == want
    assert (7, 116, 1, False) in want and (9, 116, 7, False) in want
    kept = near_dedup.keep_one(docs, group).collect()
    assert ordered((r.doc_id, r.text) for r in kept) == ordered((d, t) for (d, t), (_, _, _, k) in zip(rows, brute.near_classes(rows), strict=True) if k)


def test_near_duplicates_of_repeated_and_null_ids(edges):
    rows = near_dedup.near_duplicates(edges).collect()
    assert len(rows) == len(pairs())
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert near_dedup.keep_one(edges).columns == edges.columns


def test_signatures_estimate_jaccard():
    r = np.random.default_rng(1)
    shared, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    items = np.concatenate([shared, a, shared, b])
    s = near_dedup.signatures(items, np.array([0, 700, 1400]), 512)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.06


def test_permutations_are_two_bijections():
    x = np.concatenate([np.arange(1 << 16), np.arange(1 << 31, (1 << 31) + (1 << 16))]).astype(np.uint32)
    images = []
    for steps in (near_dedup.SIGMA, near_dedup.PI):
        y = x.copy()
        near_dedup.permute(y, np.empty_like(y), steps)
        assert len(np.unique(y)) == len(x)
        images.append(y)
    assert (images[0] == images[1]).sum() < 10


def test_circulant_signature_is_the_least_of_shifted_values():
    items = np.random.default_rng(3).integers(0, 2**63, 40).astype(np.uint64)
    base = (items >> np.uint64(32)).astype(np.uint32)
    near_dedup.permute(base, np.empty_like(base), near_dedup.SIGMA)
    got = near_dedup.signatures(items, np.array([0, 40]), 16)[0]
    for k in range(16):
        x = base - np.uint32(k)
        near_dedup.permute(x, np.empty_like(x), near_dedup.PI)
        assert got[k] == x.min()


def test_hot_groups_meet_by_broadcast(spark, monkeypatch):
    from readlog.llm import components as module

    edges = spark.createDataFrame([(i, i % 3) for i in range(3, 90)] + [(200 + i, 201 + i) for i in range(9)], "a long, b long")
    want = sorted(map(tuple, components(edges).collect()))
    monkeypatch.setattr(module, "HOT_ROWS", 5)
    assert sorted(map(tuple, components(edges).collect())) == want


def test_components(spark):
    r = random.Random(2)
    for n, m in ((30, 15), (200, 180), (50, 0)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(300, 340)] if m == 15 else [])
        parent = {x: x for e in edges for x in e}
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(parent[a], parent[b])
                changed |= parent[a] != low or parent[b] != low
                parent[a] = parent[b] = low
        got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}


# search
@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 8000, "lot_terms": 700}])
def test_search_is_exact(spark, edges, sizes):
    import math

    docs = edges.select("doc_id", "text", "rank", "size").unionByName(spark.createDataFrame([(1000 + i, words(i % 37, 30 + i), 1, 2) for i in range(150)], "doc_id long, text string, rank int, size long"))
    asking = docs.filter("doc_id % 10 = 0 OR doc_id < 100 AND doc_id <> 7").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("query_id"), "text", F.lit(1).alias("tf"))
    texts = [(x["doc_id"], Counter(re.findall(rb"[0-9a-z\x80-\xff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x["text"]).encode()))) for x in docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").collect()]
    n, mean = len(texts), sum(sum(c.values()) for _, c in texts) / len(texts)
    df = Counter(w for _, c in texts for w in c)
    got: dict = {}
    for x in search.search(docs, asking, **sizes).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["doc_id"], round(x["score"], 6)))
    asked = {d: c for d, c in texts if d % 10 == 0 or d < 100 and d != 7}
    assert len(asked) > 25 and set(got) == {q for q, c in asked.items() if c}
    for q, terms in asked.items():
        scored = []
        for d, c in texts:
            size = sum(c.values())
            total = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * m * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, m in terms.items() if w in c)
            if total:
                scored.append((-round(total, 6), d))
        assert [(-s, d) for _, d, s in sorted(got.get(q, []))] == sorted(scored)[:10]


def test_documents_are_skipped():
    """Wide terms are read at few documents of a shard, and the result is that of scoring all."""
    r = np.random.default_rng(7)
    n, kinds = 12_000, 40
    rows = [np.unique(np.concatenate([r.integers(20 * (i % kinds), 20 * (i % kinds) + 20, 12), [800 + i % 4, 804]])) for i in range(n)]
    row, term = np.repeat(np.arange(n), list(map(len, rows))), np.concatenate(rows)
    count, size = r.integers(1, 4, len(row)), np.array(list(map(len, rows))) + 5
    b = search._shard([(np.arange(n) + 7, row, term, count, size)])
    read = lambda name, kind: np.frombuffer(b.column(name)[0].as_buffer(), kind)
    shard = search.Shard(read("ids", "<i8"), read("lengths", "<u4"), np.asarray(b.column("terms")[0].values), np.asarray(b.column("dfs")[0].values), read("docs", "<u4"), read("counts", "<u4"), 20.0)
    assert shard.matrix.shape[1] == 5
    seen: list[int] = []
    shard.matrix = Counted(shard.matrix, seen)
    asked, weight = np.concatenate([np.arange(40, 60), np.arange(800, 805)]), np.concatenate([np.full(20, 4.0), np.full(5, 0.1)])
    ids, scores = shard.search(shard.places(asked), weight, 10, np.zeros(0, np.int64), np.zeros(0))
    total = np.zeros(n)
    np.add.at(total, row, np.where(np.isin(term, asked), np.where(term < 800, 4.0, 0.1), 0) * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * size[row] / 20.0)))
    best = np.lexsort((np.arange(n), -np.round(total, 9)))[:10]
    assert sorted(ids.tolist()) == sorted((best + 7).tolist()) and sorted(scores) == pytest.approx(sorted(total[best]))
    assert sum(seen) < 0.05 * n
    # a query whose best documents stand in few blocks reads no postings of the others
    one, every = np.array([40, 41, 42, 800]), int(sum((term == t).sum() for t in (40, 41, 42)))
    weight = np.array([1.0, 2.0, 4.0, 0.1])
    first, best = shard.search(shard.places(one), weight, 3, np.zeros(0, np.int64), np.zeros(0))
    before = shard.decoded
    again, same = shard.search(shard.places(one), weight, 3, np.zeros(0, np.int64), np.zeros(0), floor=float(best[-1]))
    assert first.tolist() == again.tolist() and best.tolist() == same.tolist() and 0 < shard.decoded - before < every / 2
    assert len(shard.search(shard.places(one), weight, 3, np.zeros(0, np.int64), np.zeros(0), floor=1e9)[0]) == 0 and shard.decoded - before < every / 2


def test_blocks_of_whole_documents_are_skipped(spark, monkeypatch):
    """Queries of hundreds of terms read few of their lists' postings once the tenth-best score is known, and find what all scores say;
    bounds of several queries at once are those of one; so it is where the matrix has room for few terms."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL").select("doc_id", "text").orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    data, offsets = textnum.text_bytes(rows.column("text"))
    row, term, count, size = search.terms(data, offsets)
    ids, n, norm = rows.column("doc_id").to_numpy(), rows.num_rows, 1.2 * (0.25 + 0.75 * size / size.mean())
    b = search._shard([(ids, row, term, count, size)])
    read = lambda name, kind: np.frombuffer(b.column(name)[0].as_buffer(), kind)
    names, dfs = np.asarray(b.column("terms")[0].values), np.asarray(b.column("dfs")[0].values)
    idf = np.log(1 + (n - dfs + 0.5) / (dfs + 0.5))
    for room in (search.MATRIX_BYTES, 4 * n * 3):
        monkeypatch.setattr(search, "MATRIX_BYTES", room)
        shard = search.Shard(read("ids", "<i8"), read("lengths", "<u4"), names, dfs, read("docs", "<u4"), read("counts", "<u4"), float(size.mean()))
        assert 4 * n * shard.matrix.shape[1] <= room
        asked = []
        for q in range(0, n, 50):
            own = np.sort(np.flatnonzero(row == q))
            place = shard.places(np.sort(term[own]))
            asked.append((place, idf[place] * count[own][np.argsort(term[own])]))
        bounds, listed, counted = shard.wide_bounds(asked), 0, 0
        for (place, weight), most in zip(asked, bounds, strict=True):
            total, weights = np.zeros(n), np.zeros(len(names))
            weights[place] = weight
            np.add.at(total, row, weights[np.searchsorted(names, term)] * count * 2.2 / (count + norm[row]))
            best = np.lexsort((ids, -np.round(total, 7)))[:10]
            for floor in (0.0, float(total[best[-1]]) * (1 - 1e-9)):
                before = shard.decoded
                found, scores = shard.search(place, weight, 10, ids[:0], np.zeros(0), floor, most)
                last = shard.decoded - before
                assert sorted(found.tolist()) == sorted(ids[best].tolist()) and sorted(scores) == pytest.approx(sorted(total[best]))
                alone, same = shard.search(place, weight, 10, ids[:0], np.zeros(0), floor)
                assert (alone.tolist(), same.tolist()) == (found.tolist(), scores.tolist())
            counted, listed = counted + last, listed + int(dfs[place][shard.column[place] < 0].sum())
        assert 0 < counted < 0.75 * listed, (room, counted, listed)


@pytest.mark.parametrize("n, words_of", [(3, []), (99, range(99))])
def test_shard_without_wide_terms(n, words_of):
    """No words at all, and words that stand in one document each."""
    row = np.array(words_of, np.int64)
    b = search._shard([(np.arange(n), row, row, np.ones(len(row), np.int64), np.ones(n, np.int64))])
    read = lambda name, kind: np.frombuffer(b.column(name)[0].as_buffer(), kind)
    shard = search.Shard(read("ids", "<i8"), read("lengths", "<u4"), np.asarray(b.column("terms")[0].values), np.asarray(b.column("dfs")[0].values), read("docs", "<u4"), read("counts", "<u4"), 1.0)
    assert shard.matrix.shape[1] == 0
    if len(row):
        assert shard.search(shard.places(np.array([5])), np.ones(1), 10, row[:0], np.zeros(0))[0].tolist() == [5]


class Counted:
    """An array that notes how many of its items were read."""

    def __init__(self, values, seen):
        self.values, self.seen = values, seen

    def __getitem__(self, which):
        self.seen.append(len(which))
        return self.values[which]


# models
def test_language_id(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, sample_docs=40)
    joined = language_id.predict(docs, *model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.held_out())
    assert joined.filter("lang = lang_pred").count() >= 0.95 * joined.count()
    rows = {(x["doc_id"], x["lang_pred"], x["score"]) for x in language_id.predict(edges, *model).collect()}
    assert {(d, "und", 0.0) for d, t in pairs() if not any(c.isalpha() for c in t or "")} == {x for x in rows if x[1] == "und"}
    assert all(0 <= x[2] <= 1 for x in rows)
    other = spark.createDataFrame([(1, "½ ½"), (2, "² 5"), (3, "Ⅷ ①"), (4, "_ 7"), (5, "ª")], "doc_id long, text string")
    assert {x["doc_id"] for x in language_id.predict(other, *model).collect() if x["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert edges.select(language_id.held_out().alias("h")).filter("h IS NULL").isEmpty()


def test_sample_follows_counts(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("ein wort").alias("text"), F.when(F.col("id") % 100 == 0, "de").otherwise("fr").alias("lang"))
    languages, p = language_id.fit(rows, sample_docs=100)
    assert languages == ["de", "fr"] and p.shape == (len(language_id.vocabulary()[0]) + 1, 2)
    assert p[:, 0] == pytest.approx(p[:, 1], rel=0.5)


def segmentations(word, known):
    """All ways to cut a word into known pieces."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in known:
            for rest in segmentations(word[k:], known):
                yield [word[:k], *rest]


def pieces_of(word):
    import base64

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        known = {base64.b64decode(x.split()[0]) for x in lines} | {bytes([b]) for b in range(256)}
    from readlog.llm import textnum

    number = {}
    hashes = language_id.vocabulary()[0]
    for p in {word[a:b] for a in range(len(word)) for b in range(a + 1, len(word) + 1)} & known:
        prefix, powers = textnum.byte_prefix(np.frombuffer(p, np.uint8), 21)
        number[p] = int(np.searchsorted(hashes, textnum.range_hash(prefix, powers, np.array([0]), np.array([len(p)]))[0]))
    return number


@pytest.mark.parametrize("word", [b" thethere", b" \xc3\xa4\xc3\xb6xyz", b" international"])
def test_forward_sums_all_segmentations(word):
    hashes, sizes = language_id.vocabulary()
    p = np.append(np.random.default_rng(0).random(len(hashes)), 0.0) / len(hashes)
    table = language_id.piece_table(np.frombuffer(word, np.uint8).reshape(1, -1), language_id.Lookup(hashes, sizes))
    number = pieces_of(word)
    ways = [[number[x] for x in way] for way in segmentations(word, number)]
    assert len(ways) > 10
    likelihood = [np.prod(p[way]) for way in ways]
    assert language_id.forward(table, 1, p[:, None])[0, 0] == pytest.approx(np.log(sum(likelihood)))
    want = np.zeros(len(hashes))
    for way, x in zip(ways, likelihood, strict=True):
        np.add.at(want, way, 3 * x / sum(likelihood))
    assert language_id.expected(table, p, np.array([3.0])) == pytest.approx(want)


def test_forward_of_long_words_is_rescaled():
    from fractions import Fraction

    word = b" " + bytes(np.random.default_rng(2).integers(97, 123, 120).astype(np.uint8))
    hashes, sizes = language_id.vocabulary()
    p = np.append(np.random.default_rng(1).random(len(hashes)), 0.0) / len(hashes) ** 2
    number, total = pieces_of(word), [Fraction(1)] + [Fraction(0)] * len(word)
    for end in range(1, len(word) + 1):
        total[end] = sum((total[a] * Fraction(p[number[word[a:end]]]) for a in range(end) if word[a:end] in number), Fraction(0))
    table = language_id.piece_table(np.frombuffer(word, np.uint8).reshape(1, -1), language_id.Lookup(hashes, sizes))
    import math

    want = math.log(total[-1].numerator) - math.log(total[-1].denominator)
    assert language_id.forward(table, 1, p[:, None])[0, 0] == pytest.approx(want)
    assert language_id.expected(table, p, np.array([1.0])) @ sizes == pytest.approx(len(word))


def test_words_of_any_length_sum_all_segmentations():
    r = np.random.default_rng(5)
    hashes, sizes = language_id.vocabulary()
    lookup, number = language_id.Lookup(hashes, sizes), len(hashes)
    p = np.vstack([r.random((number, 3)) / number, np.zeros((1, 3))])
    words = [b" " + bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (1, 33, 97, 98, 150, 191)]
    table = lambda w: language_id.piece_table(np.frombuffer(w, np.uint8).reshape(1, -1), lookup)
    want = np.vstack([language_id.forward(table(w), 1, p) for w in words])
    with np.errstate(divide="ignore"):
        assert language_id.long_forward(words, lookup, np.log(p)) == pytest.approx(want)
    assert language_id.Scorer(p).words([w[1:].decode() for w in words]) == pytest.approx(want)
    weight = np.arange(1.0, 7)
    counts = sum(language_id.expected(table(w), p[:, 0], weight[i : i + 1]) for i, w in enumerate(words))
    assert language_id.long_expected(words, lookup, p[:, 0], weight) == pytest.approx(counts)
    uneven = [b" " + b"a" * 4000 + bytes(r.integers(97, 123, 4000).astype(np.uint8))]
    assert language_id.long_expected(uneven, lookup, p[:, 0], np.ones(1)) @ sizes == pytest.approx(len(uneven[0]))


def test_runs_are_whole_and_languages_all(spark):
    """A run of 33 letters, and of 30,000, is one word; 300 languages are fitted and scored in passes of 40."""
    assert [len(w) for w in language_id.WORDS.findall("é" * 33 + " " + "字" * 500)] == [33, 500]
    rows = [(3 * i, f"{''.join(chr(97 + (i // 26**k) % 26) for k in range(4)) * 3} wort{chr(97 + i % 26)}", f"l{i:03d}") for i in range(300)]
    rows = [(d * 7, t, lang) for d, t, lang in rows]
    docs = spark.createDataFrame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1], "doc_id long, text string, lang string")
    languages, p = language_id.fit(docs)
    assert len(languages) == docs.count() > 180
    asked = docs.unionByName(spark.createDataFrame([(1, "字" * 3000 + "a" * 3000, None), (2, None, None), (4, "7", None)], docs.schema))
    whole = sorted(map(tuple, language_id.predict(asked, languages, p).collect()))
    parts = sorted(map(tuple, language_id.predict(asked, languages, p, model_bytes=8 * 40 * len(p)).collect()))
    assert [x[:2] for x in whole] == [x[:2] for x in parts] and [x[2] for x in whole] == pytest.approx([x[2] for x in parts])
    found = {d: lang for d, lang, _ in whole}
    assert sum(found[d] == lang for d, _, lang in docs.collect()) > 0.9 * len(languages) and found[2] == found[4] == "und"
    small = language_id.Scorer(p, cache=1)  # words in parts
    texts = [t for _, t, _ in rows] * 4 + [" ".join(t for _, t, _ in rows)]
    small.most = 7
    assert small(texts)[1] == pytest.approx(language_id.Scorer(p)(texts)[1])


def plain_statistics(text):
    """The statistics of quality_model.NAMES, one text at a time."""
    data = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if x]
    n, m = max(1, len(w)), max(1, len(lines))
    triples = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    out = [np.log1p(len(data)), np.log1p(len(w)), sum(map(len, w)) / n, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:])) / n, len(triples) / max(1, len(w) - 2), max(Counter(w).values(), default=0) / n]
    out += [np.log1p(len(lines)), len(set(lines)) / m, len(w) / m]
    return out + [sum(c in members for c in data) / max(1, len(data)) for members in quality_model.CLASSES.values()]


def test_statistics_are_the_plain_ones():
    import pyarrow as pa

    from readlog.llm import textnum

    texts = [t for _, t in pairs()] + ["\n", "\n\na b\n\n", "a\nb\na\n", "x\n"]
    got = quality_model.statistics(*textnum.text_bytes(pa.array(texts, pa.string())))
    for t, x in zip(texts, got, strict=True):
        assert x.tolist() == pytest.approx(plain_statistics(t)), t


def test_flat_trees_are_walked_as_plain_ones():
    r = np.random.default_rng(6)
    x, nodes = r.random((50, 4)).round(1), 7
    model = quality_model.Trees(r.integers(0, 4, (5, nodes)), r.random((5, nodes)).round(1), r.normal(size=(5, nodes + 1)), 0.3)
    model.threshold[0, 2] = np.inf
    for row, got in zip(x, model.score(x), strict=True):
        total = model.base
        for t in range(5):
            node = 0
            while node < nodes:
                node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
            total += model.leaf[t, node - nodes]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_first_split_has_the_largest_gain():
    r = np.random.default_rng(8)
    x = r.random((300, 3)).round(2)
    y = (x[:, 1] > 0.6).astype(float)
    model = quality_model.fit_trees(x, y, trees=1, depth=1, least=1)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda part: g[part].sum() ** 2 / (h[part].sum() + 1)
    best = max(gain(x[:, f] <= c) + gain(x[:, f] > c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_model.BINS + 1)[1:-1])))
    f, c = model.feature[0, 0], model.threshold[0, 0]
    assert f == 1 and gain(x[:, f] <= c) + gain(x[:, f] > c) == pytest.approx(best)


def test_quality_model(spark, edges):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.fit(docs, labels)
    rows = quality_model.predict(docs, model).join(labels, "doc_id").filter(quality_model.held_out())
    assert rows.filter("predicted = quality").count() >= 0.85 * rows.count()
    scores = quality_model.predict(edges, model).collect()
    assert len(scores) == len(pairs()) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in scores)


# the pipeline
def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / str(i)))
        frames.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(f.columns == columns for f in frames[:-1])
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert ids[1] == {r["doc_id"] for r in quality_rules.judge(docs).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"]) for r in frames[1].collect()]
    assert ids[2] == {x[0] for x in brute.near_classes(rows) if x[3]}
    rows = [(r["doc_id"], r["text"]) for r in frames[2].collect()]
    left = {x[0]: x for x in brute.repeats_by_word(rows)}
    assert ids[3] == {d for d, x in left.items() if x[1] != x[2] or x[1] == 0}
    mix = {r["doc_id"]: r["taken"] for r in mixing.mix(frames[3]).collect()}
    got = Counter()
    for r in frames[4].collect():
        got[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
    assert got == Counter({d: n for d, n in mix.items() if n})
    assert frames[5].count() == packing.binary_pieces(frames[4]).count()
