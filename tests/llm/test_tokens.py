"""Encoding, token files, packing and token counts against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from codexflow.llm import common, packing, token_counts, token_output
from codexflow.llm.encode import BYTE, WORD, Encoder, tokenizer_path
from tokenizers import Tokenizer

ODD = [
    "", " ", "\n\n a", "a b  c　 d", "Σας ΣΑΣ İstanbul é a ́b", "don't we'll  'S x\t\ty \n\n",
    "<|endoftext|> a<|endoftext|>b", "\x1ca\x0b b", "x" * 5000, "日本語 。。", "a﻿b ​ c", "  lead and trail  ", "1234 5 6,7.. !!!\r\n\r\nz",
    "a\n \nb", "a \n b", "ªº² ßÉ", "\U0001d4b3 \U0001f600", "naïve, été.",
]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(3)
    made = ["".join(rng.choice(" \n\t\r aA1'́ .<éZ9|>") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    whole, own = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name), name == BYTE, keep=50)
    for text in ODD + made:
        assert own.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def table(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(40, None), (41, "word " * 3000), (41, "word " * 3000), (None, "no id"), (41, "other"), (-3, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": common.F.lit("x"), "length": common.F.lit(1)})
    return rows, df.repartition(3)


def ids_of(name, text):
    return [*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files_round_trip(spark):
    rows, df = table(spark)
    files = token_output.write_token_files(df)
    got = [tuple(r) for r in token_output.read_documents(files, spark).collect()]
    want = Counter((d, len(x := ids_of(WORD, t)), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in rows)
    assert Counter((d, n, c) for d, _, n, c in got) == want
    start = 0
    for d, s, n, _ in sorted(got, key=lambda r: r[1]):
        assert s == start
        start += n
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert [x.tolist() for x in token_output.read_ids(files, spark, 41)].count(ids_of(WORD, "word " * 3000)) == 2
    assert token_output.read_ids(files, spark, 999) == []


def test_token_files_of_an_empty_table(spark):
    files = token_output.write_token_files(spark.createDataFrame([], "doc_id long, text string"))
    assert token_output.read_documents(files, spark).count() == 0


def check_packing(got, want, capacity):
    """Every piece once, cut as the contract says, without gaps or overlaps."""
    bins = {}
    for d, p, s, n, c, q, o in got:
        bins.setdefault(q, []).append((o, n))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    assert Counter((d, p, s, n, c) for d, p, s, n, c, _, _ in got) == Counter(want)


def test_packing_places_every_piece(spark):
    rows, df = table(spark)
    want = []
    for d, t in rows:
        ids = ids_of(BYTE, t)
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    packed = packing.pack_documents(df, with_ids=True)
    check_packing([tuple(r)[:7] for r in packed.collect()], want, 1024)
    whole = packing.sequences(packed)
    assert whole.selectExpr("sum(length(ids)) / 4").first()[0] == sum(w[3] for w in want)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_of_counts_is_tight():
    rng = random.Random(5)
    for capacity, n in ((20, 400), (1024, 5000), (7, 50), (1024, 3)):
        counts = Counter(rng.randint(1, capacity) for _ in range(n))
        counts[capacity // 3] += n // 2
        slots = packing.pack_lengths(dict(counts), capacity)
        bins, ranks = Counter(), Counter()
        for w, a, b, s, each, _ in slots:
            assert a == ranks[w]
            ranks[w] = b
            for r in range(b - a):
                bins[s + r // each] += w
        assert +ranks == +counts and max(bins.values()) <= capacity
        low = -(-sum(w * c for w, c in counts.items()) // capacity)
        assert len(bins) <= low * 1.05 + 2 and sorted(bins) == list(range(len(bins)))


def best_by_search(items, capacity):
    """The least number of bins, by trying every place for each item."""
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= items[i]:
                place(i + 1, [r - items[i] * (k == x) for x, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_least_number_of_bins():
    rng = random.Random(8)
    for _ in range(60):
        items = sorted((rng.randint(2, 12) for _ in range(9)), reverse=True)
        left = [0] * 13
        for w in items:
            left[w] += 1
        fixed = sum(b.count for b in packing.reduce_dominated(left, 12))
        rest = [w for w in range(12, 0, -1) for _ in range(left[w])]
        assert fixed + best_by_search(rest, 12) == best_by_search(items, 12), items


def test_token_counts(spark):
    rows, df = table(spark)
    lengths = [len(ids_of(BYTE, t)) - 1 for _, t in rows]
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(df)))
    got = {r.context_limit: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for limit, r in got.items():
        assert (r.n_docs, r.docs_over) == (lengths.count(limit), sum(n > limit for n in lengths))
        assert (r.truncated_total, r.tokens_over) == (sum(min(n, limit) for n in lengths), sum(n for n in lengths if n > limit))
        assert r.quantile == pytest.approx(sum(n <= limit for n in lengths) / len(lengths)) and r.lost == sum(max(0, n - limit) for n in lengths)
    asked = spark.createDataFrame([(-1,), (0,), (7,), (2999,), (10**6,)], "context_limit long")
    for r in token_counts.answer_limits(sums, asked).collect():
        assert (r.docs_over, r.truncated_total) == (sum(n > r.context_limit for n in lengths), sum(min(n, r.context_limit) for n in lengths))
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(df.limit(0)))).count() == 0
