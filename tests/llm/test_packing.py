import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_fixtures import frame, odd_rows, prose
from mediamatch.llm import packing


def whole_encoder():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("seed", range(20))
def test_closest_fill_is_best_subset(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 40) for _ in range(9)]
    room = rng.randint(5, 120)
    best = max(sum(c) for k in range(10) for c in combinations(lengths, k) if sum(c) <= room)
    taken = packing.closest_fill(Counter(lengths), room)
    assert sum(length * n for length, n in taken.items()) == best
    assert all(n <= Counter(lengths)[length] for length, n in taken.items())


def test_tail_is_cut_into_powers_of_two():
    pieces = [(1, 0, np.arange(70), 70), (2, 0, np.arange(29), 29)]
    sizes = [sum(len(p[2]) for p in s) for s in packing.cut_tail(pieces, 64)]
    assert sizes == [64, 32, 2, 1]


def check_pieces(rows, texts):
    """Every id lies in exactly one piece, sequences have no gap and no padding but for powers of two."""
    encode = whole_encoder()
    ids = {d: [*encode.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids[doc]))
            own = np.array(ids[doc][at : at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(own)
            at += r["length"]
        assert at == len(ids[doc])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_pack_round_trip(spark):
    texts = dict(enumerate(prose(1, 120, 900)))
    texts |= {1000: None, 1001: "", 1002: "Straße 東京 naïve ﬁ", 1003: "<|endoftext|> tail", 1004: "ab " * 9000}
    rows = frame(spark, [(d, t, None, None) for d, t in texts.items()]).repartition(3)
    check_pieces(packing.pack(rows).collect(), texts)


def test_pack_odd_rows_and_empty_table(spark):
    rows = odd_rows()
    got = packing.pack(frame(spark, rows)).collect()
    encode = whole_encoder()
    total = sum(len(encode.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in rows)
    assert sum(r["length"] for r in got) == total
    assert packing.pack(frame(spark, [])).collect() == []


def test_fast_encoder_gives_the_vocabulary_ids():
    encode, whole = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), whole_encoder()
    for text in [*prose(3, 40), "it's  two   spaces\n\nand ñ ß – “q” …", "tab\tx y", " lead", "1234 5,6", "á"]:
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids
