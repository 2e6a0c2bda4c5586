import hashlib
import random
import struct
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlattice.llm import webp as w


def payloads(*texts):
    return [w.payload_of(t) for t in texts]


def sample():
    r = random.Random(5)
    return payloads("", None, "a", "And " * 3000, "x" * 9000, "ab" * 5000, "日本語テキスト" * 500, "".join(r.choice("abc \n") for _ in range(30_000)), "".join(chr(r.randrange(32, 1000)) for _ in range(20_000)), "Z" * 8193, *("the quick brown fox " * i + str(i) for i in range(60)))


def test_round_trip_by_both_decoders():
    given_ = sample()
    files = w.encode_files(given_)
    assert [x.tobytes() for x in w.decode_files(files)] == given_
    for p, f in zip(given_, files, strict=True):
        frames = w.frames_of(f)[2]
        assert b"".join(w.decode_stream(s).tobytes() for _, _, s in frames) == p


def test_the_samples_hold_every_transform():
    kinds = set()
    for f in w.encode_files(sample()):
        for _, _, s in w.frames_of(f)[2]:
            kinds |= {t[0] for t in w.Head(s).transforms}
    assert kinds == {w.PREDICTOR, w.CROSS, w.GREEN, w.PALETTE}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_any_bytes(blobs):
    given_ = [b + b"\0" * (max(1, -(-len(b) // 64)) * 64 - len(b)) for b in blobs]
    assert [x.tobytes() for x in w.decode_files(w.encode_files(given_))] == given_


class Writer(w.Accumulator):
    def data(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")

    def simple(self, *symbols):
        self.put(1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
        for s in symbols:
            self.put(s, 8)


def head(width, height):
    a = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        a.put(v, n)
    return a


def test_several_code_groups_and_plain_reference():
    """2 x 8 pixels in two groups of codes by rows, written by hand: the upper tile is green 1 or 2, the lower 9."""
    a = head(2, 8)
    a.put(0, 1)  # no transform
    a.put(0, 1)  # no cache
    a.put(1, 1)  # several groups
    a.put(0, 3)  # tiles of 4 x 4
    a.put(0, 1)  # the group image has no cache; green is the group: 0, then 1
    a.simple(0, 1)
    for _ in range(4):
        a.simple(0)
    a.put(0, 1)
    a.put(1, 1)
    a.simple(1, 2)
    for _ in range(3):
        a.simple(0)
    a.simple(0)
    a.simple(9)
    for _ in range(4):
        a.simple(0)
    for bit in (0, 1, 1, 0, 0, 0, 1, 1):
        a.put(bit, 1)
    want = [1, 2, 2, 1, 1, 1, 2, 2] + [9] * 8
    assert w.decode_stream(a.data())[..., 1].ravel().tolist() == want
    assert w.decode_streams([a.data()])[0][..., 1].ravel().tolist() == want


def test_a_cache_slot_read_before_it_is_set():
    """4 x 1 pixels: slot 1 (unset, so transparent black, which goes to slot 0), a literal, slot 0, the literal's slot."""
    a = head(4, 1)
    a.put(0, 1)  # no transform
    a.put(1 | 1 << 1, 5)  # a cache of two slots
    a.put(0, 1)  # one group
    # green: length 1 for 7, 2 for the slots' symbols 280 and 281
    a.put(w._NORMAL, w._NORMAL_BITS)
    for run, n in ((7, 1), (272, 2), (0, 2)):
        while run:
            step = min(run, 138)
            s, more, extra = (18, 7, step - 11) if step >= 11 else (17, 3, step - 3)
            a.put(int(w._LENGTH_VALUES[s]) | extra << int(w._LENGTH_SIZES[s]), int(w._LENGTH_SIZES[s]) + more)
            run -= step
        a.put(int(w._LENGTH_VALUES[n]), int(w._LENGTH_SIZES[n]))
    for _ in range(4):
        a.simple(0)
    slot = (w.CACHE_FACTOR * (7 << 8) & 0xFFFFFFFF) >> 31
    hit = {0: (1, 2), 1: (3, 2)}  # codes 10 and 11, first bit lowest
    for value, n in (hit[1], (0, 1), hit[0], hit[slot]):
        a.put(value, n)
    want = w.decode_stream(a.data())
    assert want[..., 1].ravel().tolist() == [0, 7, 7 if slot == 0 else 0, 7]
    assert (w.decode_streams([a.data(), *w.frames_of(w.encode_files(payloads("b" * 99))[0])[2][0][2:]])[0] == want).all()


def test_steps_are_tokens_and_batches_share_them():
    """600 pixels of noise, then one long copy: as many steps as tokens, not pixels."""
    blobs = (np.random.default_rng(i).bytes(2400) + b"\0" * (64 * 128 - 2400) for i in range(100))
    made = ((b, w.frames_of(w.encode_files([b])[0])[2][0][2]) for b in blobs)
    blob, stream = next((b, s) for b, s in made if not w.Head(s).transforms)
    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        got = w.decode_streams([stream])
    finally:
        sys.setprofile(None)
    assert got[0].tobytes() == blob and calls < 60_000
    assert len(list(w.batches_of([2400] * 3000))) == 1


def test_lanes_are_decoded_in_parts(monkeypatch):
    given_ = sample()
    files = w.encode_files(given_)
    monkeypatch.setattr(w, "LANES", 3000)
    assert [x.tobytes() for x in w.decode_files(files)] == given_


@pytest.mark.parametrize("mode", range(14))
def test_predictors_invert(mode):
    r = np.random.default_rng(mode)
    image = r.integers(0, 256, (9, 7, 4), np.uint8)
    t = (w.PREDICTOR, 7, 2, [0xFF000000 | ((mode + i) % 14) << 8 for i in range(w.tiles(7, 2) * w.tiles(9, 2))])
    left = [w.predicted(image, w.modes_of(t, 7, 9))]
    w.undo_predictors(left, [t])
    assert (left[0] == image).all()


def test_cross_colour_inverts_and_palettes_unpack():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (8, 16, 4), np.uint8)
    t = (w.CROSS, 16, 4, [0xFF8370F1])
    assert (w.cross_colour(w.cross_colour(image, t, -1), t, 1) == image).all()
    packed = np.zeros((1, 2, 4), np.uint8)
    packed[0, :, 1] = [0b11100100, 0b00000001]
    colours = w.unpack(packed, (w.PALETTE, 5, 2, np.array([10, 20, 30], "<u4")))
    assert colours.view("<u4").ravel().tolist() == [10, 20, 30, 0, 20]  # an index beyond the palette is transparent black


def test_prefixes_and_distances():
    x = np.arange(1, 5000)
    code, more, n = w.prefixed(x)
    for v, c, m, k in zip(x[::37], code[::37], more[::37], n[::37], strict=True):
        b = w.Bits(int(m).to_bytes(4, "little"))
        assert w.spread(b, int(c)) == v and b.at == k
    assert len(set(w.NEIGHBOURS)) == 120 and w.distances(16)[1] == 16 and w.distances(16)[2] == 1 and w.distances(1).min() == 0


def test_code_lengths_are_complete_and_short():
    r = np.random.default_rng(2)
    counts = r.integers(0, 50, (40, 300)) * (r.random((40, 300)) < r.random((40, 1)))
    counts[0] = 0
    counts[1] = 0
    counts[1, 7] = 3
    n = w.code_lengths(counts)
    assert n.max() <= w.DEEPEST and not n[:2].any()
    many = (counts > 0).sum(axis=1) > 1
    assert (np.where(n[many] > 0, 2.0 ** -n[many], 0).sum(axis=1) == 1).all() and ((n[many] > 0) == (counts[many] > 0)).all()


@pytest.mark.parametrize("spoil", [lambda f: f[: len(f) // 2], lambda f: b"JUNK" + f[4:], lambda f: f[:20] + b"\x00" + f[21:], lambda f: f[:12]])
def test_damage_is_an_error(spoil):
    f = w.encode_files(payloads("some text " * 50))[0]
    with pytest.raises(ValueError):
        w.decode_file(spoil(f))


def test_container():
    f = w.encode_files(payloads("long " * 5000))[0]
    assert f[:4] == b"RIFF" and struct.unpack("<I", f[4:8])[0] == len(f) - 8 and f[8:16] == b"WEBPVP8X"
    width, height, frames = w.frames_of(f)
    assert (width, height) == (16, 25024 // 64) and [y for _, y, _ in frames] == [0, 128, 256, 384]


def test_digests(docs):
    texts = ["", None, "a", "a", "é" * 100, "And " * 5000]
    got = {r.doc_id: r for r in w.digests(docs(*enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        p, r = w.payload_of(t), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[2].media_sha256 == got[3].media_sha256 and got[0].payload_bytes == 64
    media = w.stored(docs(*enumerate(texts)))
    back = {r.doc_id: r for r in w.pixels(media.selectExpr("doc_id", "if(doc_id = 0, null, media) as media", "'x' as width")).collect()}
    assert back[0].pixels is None and bytes(back[5].pixels) == w.payload_of(texts[5]) and back[5].width == 16
    assert w.digests(docs((1, "x")).where("false")).count() == 0
