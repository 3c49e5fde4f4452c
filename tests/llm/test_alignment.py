"""Operator 12 against the libraries and all pairs of tokens."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from codeprep.llm import alignment, queries
from tests.llm import cases

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


BYTE = byte_of()


def ranges(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def tokens_of(text):
    if not text:
        return None
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    bytes_a = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(B.id_to_piece, b))]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    return a, b, ranges(bytes_a), ranges(bytes_b)


def alignment_of(rows):
    docs = []
    for d, t in rows:
        got = tokens_of(t)
        if got is None:
            docs.append((d, 0, 0, 0, [], ""))
            continue
        a, b, ra, rb = got
        links, start = [], 0
        for i, (x, y) in enumerate(ra):
            while rb[start][1] <= x:
                start += 1
            j = start
            while j < len(rb) and rb[j][0] < y:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({y for _, y in ra} & {y for _, y in rb})
        spelt, lo = [], 0
        for hi in cuts:
            spelt.append("|".join(",".join(str(t) for t, (x, _) in zip(ids, r) if lo <= x < hi) for ids, r in ((a, ra), (b, rb))))
            lo = hi
        docs.append((d, len(a), len(b), len(cuts), links, sha256(";".join(spelt).encode()).hexdigest()))
    count = Counter(pair for doc in docs for pair in doc[4])
    high = {}
    for (_, y), n in count.items():
        high[y] = max(n, high.get(y, 0))
    return [(d, n, m, g, len(links), sum(count[p] == high[p[1]] for p in links), sum(count[p] for p in links), s) for d, n, m, g, links, s in docs]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect())


def test_alignment(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000")  # all pairs of long texts' groups are slow here
    want = Counter(alignment_of([(r.doc_id, r.text) for r in df.collect()]))
    assert rows_of(alignment.align(df, queries.BYTE_BPE, queries.PIECE_BPE)) == want
    # chunks of a few documents give the same counts
    assert rows_of(alignment.align(df, queries.BYTE_BPE, queries.PIECE_BPE, chunk_links=3000)) == want


def test_alignment_edges(spark):
    texts = ["<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "漢字🙂é́", "\x00\t\n\r\n  x", " lead", "trail   ", "ﬁ \xa0", "a", "\U0001faf9 new", "é" * 3000, "1234567890" * 300]
    extra = spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    df = cases.table(spark).select("doc_id", "text").unionByName(extra)
    want = Counter(alignment_of([(r.doc_id, r.text) for r in df.collect()]))
    assert rows_of(alignment.align(df, queries.BYTE_BPE, queries.PIECE_BPE)) == want
    zero = {d for (d, n, *_, s), _ in want.items() if not n and s == ""}
    assert {4, 5, 501, None} <= zero and 500 not in zero
    assert alignment.align(cases.empty(spark), queries.BYTE_BPE, queries.PIECE_BPE).count() == 0


def test_diagonal_runs():
    rng = random.Random(3)
    for _ in range(300):
        last = rng.randint(1, 60)
        share = rng.random()
        a = sorted({rng.randrange(1, last + 1) for _ in range(last)} | {last})
        b = sorted({x for x in a if rng.random() < share} | {rng.randrange(1, last + 1) for _ in range(rng.randint(0, 9))} | {last})
        runs, irregular = alignment.diagonal_runs(a, b)
        links = sorted(zip(*map(np.ndarray.tolist, alignment.links_of(a, b, runs, irregular))))
        groups = sorted([(i + k, j + k, 1, 1) for i, j, n in runs for k in range(n)] + [(i, j, x + 1 - i, y + 1 - j) for i, x, j, y in irregular])
        spans_a, spans_b = list(zip([0, *a], a)), list(zip([0, *b], b))
        assert links == [(i, j) for i, (x, y) in enumerate(spans_a) for j, (u, v) in enumerate(spans_b) if x < v and u < y]
        ends = [(a[i + n - 1], b[j + m - 1]) for i, j, n, m in groups]
        assert ends == [(x, x) for x in sorted(set(a) & set(b))]


def test_best_matches(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "the end")], "doc_id bigint, text string")
    got = {r.b_id: (r.a_id, r.n) for r in alignment.best_matches(df, queries.BYTE_BPE, queries.PIECE_BPE).collect()}
    assert got[B.encode("the")[0]] == (A.encode(" the").ids[0], 3)
