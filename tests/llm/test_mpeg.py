"""Frames of every layer built bit by bit: durations over changing sample rates, offsets, and checksums."""

import random
from fractions import Fraction

import pytest

from tidepool.llm import mpeg

MONO, JOINT, STEREO = 3, 1, 0


def slow_crc(bits):
    x = 0xFFFF
    for bit in bits:
        top = x >> 15
        x = x << 1 & 0xFFFF
        if top ^ bit:
            x ^= 0x8005
    return x


def bits_of(data):
    return [byte >> k & 1 for byte in data for k in range(7, -1, -1)]


def frame(layer, rate_index, frequency, mode, rng, protected=True, extension=0, broken=False):
    """A frame of MPEG-1 with random content and, for layers I and II, the checksum of its allocation as the standard words it."""
    head = bytes((0xFF, 0xF8 | (4 - layer) << 1 | (not protected), rate_index << 4 | frequency << 2, mode << 6 | extension << 4))
    header = mpeg.read_header(head)
    body = bytes(rng.choice((0, rng.randrange(256))) for _ in range(header.size - 6))
    bits, channels = bits_of(body), 1 if mode == MONO else 2
    bound = 4 * (extension + 1) if mode == JOINT else 32
    if layer == 1:
        covered = sum(4 * (channels if band < bound else 1) for band in range(32))
    elif layer == 2:
        # 48 kHz at 64 kbit/s and more a channel: 27 subbands of 4, 3 and 2 bits
        covered = selections = 0
        for band in range(27):
            width = 4 if band < 11 else 3 if band < 23 else 2
            for _ in range(channels if band < bound else 1):
                if any(bits[covered : covered + width]):
                    selections += 1 if band < bound else channels
                covered += width
        covered += 2 * selections
    else:
        covered = 8 * header.checked
    crc = slow_crc(bits_of(head[2:4]) + bits[:covered]) ^ broken
    return head + (crc.to_bytes(2, "big") + body if protected else body + b"\0\0")


@pytest.mark.parametrize("layer, rate_index", [(1, 9), (2, 10), (3, 9)])
@pytest.mark.parametrize("mode, extension", [(MONO, 0), (STEREO, 0), (JOINT, 0), (JOINT, 2), (JOINT, 3)])
def test_checksums_of_all_layers(layer, rate_index, mode, extension):
    rng = random.Random(layer * 10 + mode)
    good = [frame(layer, rate_index, 1, mode, rng, extension=extension) for _ in range(6)]
    audio = mpeg.read(b"".join(good))
    assert (len(audio.offsets), audio.checked, audio.failed) == (6, 6, 0)
    bad = good[:2] + [frame(layer, rate_index, 1, mode, rng, extension=extension, broken=True)] + good[3:]
    assert mpeg.read(b"".join(bad)).failed == 1
    assert mpeg.read(b"".join(frame(layer, rate_index, 1, mode, rng, protected=False) for _ in range(3))).checked == 0


def test_durations_and_offsets_over_changing_rates():
    rng = random.Random(1)
    parts = [frame(3, 9, 0, STEREO, rng) for _ in range(10)] + [frame(3, 9, 1, STEREO, rng) for _ in range(10)] + [frame(2, 10, 1, MONO, rng) for _ in range(4)] + [frame(1, 9, 2, MONO, rng) for _ in range(5)]
    audio = mpeg.read(b"".join(parts))
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p)
    assert audio.offsets == starts
    lengths = [Fraction(1152, 44100)] * 10 + [Fraction(1152, 48000)] * 14 + [Fraction(384, 32000)] * 5
    assert audio.duration == sum(lengths)
    begin = Fraction(0)
    for start, length in zip(starts, lengths):
        assert audio.seek(begin) == audio.seek(begin + length - Fraction(1, 10**9)) == start
        begin += length
    assert audio.seek(begin) is None
    assert "duration=1920/32000+11520/44100+16128/48000;" in mpeg.feature(audio)


def test_allocation_tables():
    sizes = {}
    for rate_index, frequency, mode in ((10, 1, MONO), (14, 0, MONO), (1, 0, MONO), (1, 2, MONO), (8, 1, STEREO), (4, 0, STEREO)):
        header = mpeg.read_header(bytes((0xFF, 0xFC, rate_index << 4 | frequency << 2, mode << 6)))
        sizes[rate_index, frequency, mode] = len(mpeg.allocation_bits(header))
    assert sizes == {(10, 1, 3): 27, (14, 0, 3): 30, (1, 0, 3): 8, (1, 2, 3): 12, (8, 1, 0): 27, (4, 0, 0): 8}
    low = mpeg.read_header(bytes((0xFF, 0xF4, 8 << 4, 0xC0)))
    assert sum(mpeg.allocation_bits(low)) == 4 * 4 + 7 * 3 + 19 * 2
