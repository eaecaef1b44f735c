"""What tasks over texts take, and what workers, which outlive their tasks, keep of it."""

import tracemalloc

import numpy as np

from tallyweave.llm import language, textkit, token_files
from tallyweave.llm.queries import vocabulary


def traced(work):
    """What ``work`` returns, and the bytes it keeps and takes at most."""
    tracemalloc.start()
    try:
        out = work()
        return out, *tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_margins_take_no_more_for_more_bits():
    rand = np.random.default_rng(1)
    data, offsets = rand.integers(0x61, 0x7B, 400_000).astype(np.uint8), np.array([0, 0, 150_000, 150_001, 400_000])
    most = {}
    for bits in (2, 60):
        odds = {g: rand.normal(size=(language.SLOTS + 1, bits)).astype(np.float32) for g in language.GRAMS}
        model = language.Model(["a", "b"], np.ones((2, bits), np.int8), odds, np.ones(bits), np.ones((2, bits)))
        margins, _, most[bits] = traced(lambda model=model: model.margins(data, offsets))
        for n, (first, last) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            own = [language.slots(language.SEEN[data[first:last]], np.array([0, last - first]), g) for g in language.GRAMS]
            seen = max(1, sum(int((x < language.SLOTS).sum()) for x in own))
            assert np.allclose(margins[n], sum(odds[g][x].sum(axis=0, dtype=float) for g, x in zip(language.GRAMS, own, strict=True)) / seen)
    assert most[60] <= 1.1 * most[2] + 100_000


def test_hashes_of_spans_keep_nothing_and_are_those_of_a_plain_polynomial():
    base, mask = 0x9E3779B97F4A7C15 + 2 * 5 * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1, (1 << 64) - 1
    values = np.random.default_rng(2).integers(0, 256, 3 * textkit.STRIDE + 7).astype(np.uint8)
    n = len(values)
    starts = np.array([0, 0, 5, textkit.STRIDE - 1, textkit.STRIDE, 2 * textkit.STRIDE - 3, n - 1, n, n])
    ends = np.array([0, n, 9, textkit.STRIDE + 1, 3 * textkit.STRIDE, 2 * textkit.STRIDE + 3, n, n, n])
    plain = [sum((int(v) + 1) * pow(base, i, 1 << 64) for i, v in enumerate(values[a:b])) + (b - a) * 0x9E3779B97F4A7C15 + 5 & mask for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert (textkit.spans(values, starts, ends, 5) == textkit.mix(np.array(plain, np.uint64))).all()
    assert not len(textkit.spans(values[:0], starts[:0], ends[:0]))
    data = np.zeros(2_000_000, np.uint8)
    _, kept, _ = traced(lambda: textkit.spans(data, np.array([0]), np.array([len(data)]), 11))
    assert kept < 100_000


def test_pieces_that_an_encoder_remembers_take_some_bytes_each():
    tool = token_files.Encoder(vocabulary())
    words = [f"w{n * 2654435761 % 1_000_003:06d}x".translate(str.maketrans("0123456789", "bcdfghjklm")) for n in range(60_000)]
    texts = [" ".join(words[i : i + 5_000]).encode() for i in range(0, len(words), 5_000)]

    def encode():
        for text in texts:
            data = np.frombuffer(text, np.uint8)
            ids, counts = tool.encode(data, np.array([0, len(data)]))
            assert counts.tolist() == [len(ids)]
        return ids

    last, kept, _ = traced(encode)
    assert (last == tool.whole(texts[-1])).all() and tool.size >= 50_000
    assert kept <= 80 * tool.size
    assert (tool.known[1:] > tool.known[:-1]).all() and sorted(tool.place.tolist()) == list(range(tool.size))
    again, counts = tool.encode(np.frombuffer(b"".join(texts[:2]), np.uint8), np.cumsum([0, len(texts[0]), len(texts[1])]))
    assert (again == np.r_[tool.whole(texts[0]), tool.whole(texts[1])]).all() and counts.sum() == len(again)
