import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from readlog.llm import token_alignment as ta
from readlog.llm.tokens import default_paths

SCHEMA = "doc_id long, text string, n long, pair string, blk int, print string, count int, best int"
TESTDATA = "/root/testdata/sf0.001"


def plain(rows):
    """The query's rows by both libraries, one document and one pair of tokens at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(default_paths()[0])
    first.encode_special_tokens = True
    visible = list(range(0x21, 0x7F)) + list(range(0xA1, 0xAD)) + list(range(0xAE, 0x100))
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    second = sentencepiece.SentencePieceProcessor(model_file=ta.piece_path())

    def second_bytes(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            bytes_a = [bytes(byte_of[c] for c in first.id_to_token(i)) for i in a]
            bytes_b = [second_bytes(i) for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
                at = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for i, e in zip(a, ends_a, strict=True) if at < e <= end], [i for i, e in zip(b, ends_b, strict=True) if at < e <= end]))
                    at = end
        links = [(x, y) for g, h in groups for x in g for y in h]
        counts.update(set(links))
        docs.append((doc_id, groups, links))
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, groups, links in docs:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def texts():
    r = random.Random(3)
    signs = "abc xyz ABC  \n\té ß漢字🙂​́<|>1239.,;"
    out = [None, "", " ", "  ", "a", "hello world", "hello world", "<|endoftext|> is text", "</s> <s> <unk> <0x41>", "▁ taken for a space", "a▁b", "tab\tand\r\nline\x00end", "漢字かな交じり文", "🙂🙃 emoji 👩‍👩‍👧", "naïve café", "x" * 700, "ab" * 900, "1234567890 " * 40]
    out += ["".join(r.choice(signs) for _ in range(r.randint(1, 120))) for _ in range(80)]
    out += ["".join(chr(r.choice([r.randint(1, 0x7F), r.randint(0x80, 0x7FF), r.randint(0x800, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(30)]
    return out + ["the copy of a copy of the text"] * 40


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(texts())] + [(3, "a"), (3, "b"), (None, "hello world"), (None, None)]


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "q", 3, 4) for r in rows], SCHEMA).repartition(3)


def test_alignment_against_plain(spark, rows):
    want = plain(rows)
    for block in (ta.BLOCK, 300):
        got = ta.alignment(frame_of(spark, rows), block=block)
        assert got.columns == ["doc_id", *ta.MEASURES, "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(r[3] == 0 for r in want if r[0] in (9, 10))  # U+2581 in a text comes back as a space


def test_links_in_steps():
    pair = ta.tokenizer_pair(None, None)
    some = [t for t in texts() if t]
    (measures, digests, whole), (_, _, parts) = ta.align(pair, some), ta.align(pair, some, step=1)
    total = lambda links: Counter({(r, p): 0 for r, p, _ in zip(*map(np.ndarray.tolist, links), strict=True)}) + Counter([(r, p) for r, p, k in zip(*map(np.ndarray.tolist, links), strict=True) for _ in range(k)])
    assert total(whole) == total(parts)
    assert np.bincount(whole[0], weights=whole[2], minlength=len(some)).tolist() == measures[3].tolist()
    assert [bool(d) for d in digests] == (measures[0] > 0).tolist()


def test_squeezed_numbers():
    r = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.arange(5), r.integers(0, 1 << 62, 1000)):
        assert (ta.unsqueeze(ta.squeeze(values)) == values).all()


def test_empty_table(spark):
    assert ta.alignment(frame_of(spark, [])).collect() == []
    assert [tuple(r) for r in ta.alignment(frame_of(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query_against_plain(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").limit(60).collect()
    want = plain(map(tuple, docs))
    assert sorted(map(tuple, ta.alignment(spark.createDataFrame(docs)).collect()), key=repr) == want
    query = ta.op11_token_alignment(spark, TESTDATA)
    same = {r[0]: r[1:5] for r in want}
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links) for r in query.collect()}
    assert len(got) == 200 and {k: got[k] for k in same} == same
