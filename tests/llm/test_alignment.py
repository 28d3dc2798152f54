import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltwork.llm import alignment, registry
from siltwork.llm.tokencount import byte_alphabet

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    """Both libraries' own encodings, all pairs of tokens compared: (n_a, n_b, groups, links)."""
    a, b, alphabet = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_alphabet()
    a.encode_special_tokens = True
    entry = {i: bytes(alphabet[c] for c in t) for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, size):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + size(i)))
            at += size(i)
        return out

    def run(text):
        own, other = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or {b"".join(entry[i] for i in own), b"".join(map(piece, other))} != {(" " + text).encode()}:
            return 0, 0, "", []
        own, other = spans(own, lambda i: len(entry[i])), spans(other, lambda i: len(piece(i)))
        links = [(i, j) for i, s, e in own for j, u, v in other if s < v and u < e]
        groups, last = [], 0
        for cut in sorted({e for *_, e in own} & {e for *_, e in other}):
            groups.append("|".join(",".join(str(i) for i, s, _ in side if last <= s < cut) for side in (own, other)))
            last = cut
        return len(own), len(other), ";".join(groups), links

    return run


def texts():
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "\t", "é", "日本", "▁", "<0x0A>", "</s>", "<|endoftext|>", "<unk>", "🤦🏼‍♂️", "12", "'s", "The", "ﬁ", "İ", "--", "=\r\n", "\x00", "ing "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", " ", "   ", "a ", "  a  ", "x" * 2000, " " * 300, "▁", "a ▁b"]


def expected(rows, plain):
    found = [(i, *plain(t)) for i, t in rows]
    counts = Counter(x for *_, links in found for x in links)
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(highest.get(j, 0), n)
    return sorted(
        (str(i), a, b, len(g.split(";")) if g else 0, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), g)
        for i, a, b, g, links in found
    )


def test_against_the_libraries_own_tokens(spark, plain):
    rows = list(enumerate(texts())) + [(None, "no id here"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"chunk": F.lit("clash"), "pair": F.lit(1), "links": F.lit(2)})
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    got = sorted((str(r.doc_id), *[r[n] for n in names]) for r in alignment.scored(df, BYTES, PIECES).collect())
    assert got == expected(rows, plain)
    only = sorted((str(r.doc_id), r.n_a, r.groups) for r in alignment.align(df, BYTES, PIECES).collect())
    assert only == sorted((g[0], g[1], g[-1]) for g in got)


def test_small_chunks_and_few_kept_words_change_nothing(spark, plain, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts()[:60] * 2)]
    aligner = alignment.Aligner(BYTES, PIECES)
    monkeypatch.setattr(alignment, "WORDS", 5)
    for k in range(0, len(rows), 7):
        n_a, n_b, _, n_links, groups, _ = aligner([t for _, t in rows[k : k + 7]])
        assert [(a, b, g, n) for a, b, g, n in zip(n_a, n_b, groups, n_links, strict=True)] == [(a, b, g, len(x)) for a, b, g, x in (plain(t) for _, t in rows[k : k + 7])]


def test_query_and_an_empty_table(spark, data, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.op13_alignment(spark, data).collect()
    assert len(got) == len(docs)
    for r in got[::40]:
        a, b, groups, links = plain(docs[r.doc_id])
        assert (r.n_a, r.n_b, r.n_links, r.groups_sha256) == (a, b, len(links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert r.n_links == r.n_a + r.n_b - r.n_groups and 0 <= r.n_best <= r.n_links <= r.count_sum
    assert alignment.scored(spark.createDataFrame([], DOCS), BYTES, PIECES).count() == 0
