import math
import zlib

import numpy as np
from tokenizers import Tokenizer

from headlight.llm import common, packing
from tests.llm import fixtures


def brute_ids(texts):
    t = Tokenizer.from_file(common.public_vocabulary())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_tokenizer_equals_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    t, w = Tokenizer.from_file(common.public_vocabulary()), common.WordTokenizer(common.public_vocabulary())

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("aB\u0130 \u00e9e\u0301\u00a0\u2003\x0b\x1c\x85'st12.ßΣς<|endoftext|>\n\t中\U0001f600\u0300")))
    def same(x):
        assert w(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()

    same()


def test_pack_documents(spark):
    docs = fixtures.clashing(fixtures.docs(spark)).repartition(5)
    rows = docs.select("doc_id", "text").collect()
    got = packing.pack(docs).collect()
    want = []
    for r, ids in zip(rows, brute_ids([r["text"] for r in rows]), strict=True):
        ids = [*ids, 0]
        want += [(r["doc_id"], i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(w[3] for w in want) / 2048) + 3
    assert packing.pack(fixtures.empty(docs)).count() == 0


def test_plan_is_close_to_the_least(tmp_path):
    rng = np.random.default_rng(3)
    for scale in (50, 5000, 500_000):
        lengths = np.clip(rng.lognormal(6, 1, scale).astype(int), 1, 2048)
        h = np.bincount(lengths, minlength=2049)
        plan = packing.plan(h)
        ranks = {}
        for length, a, b, seq, offset in plan:
            ranks.setdefault(length, []).append((a, b))
            assert offset + length <= 2048 and a < b
        for length in np.flatnonzero(h):
            at = 0
            for a, b in sorted(ranks[length]):
                assert a == at
                at = b
            assert at == h[length]
        used = 1 + max(s + b - a - 1 for _, a, b, s, _ in plan)
        assert used <= 1.02 * math.ceil((h * np.arange(2049)).sum() / 2048) + 2
    assert packing.plan(np.zeros(2049, int)) == []
