"""Payload bytes that look like an ID3v1 tag."""

import pytest

from tidepool.llm import mpeg


def test_tag_bytes_inside_the_last_frame_are_payload():
    done = 0
    for n in range(64, 6000, 64):
        raw = bytes(97 + k % 26 for k in range(n))
        media = mpeg.write(raw)
        audio = mpeg.read(media)
        before = sum(size - mpeg._OVERHEAD for size in audio.sizes[:-1])
        place = before + len(media) - 128 - audio.offsets[-1] - mpeg._OVERHEAD
        if not before <= place <= n - 3:
            continue
        raw = raw[:place] + b"TAG" + raw[place + 3 :]
        media = mpeg.write(raw)
        assert media[-128:-125] == b"TAG"
        assert mpeg.payload_of(media, mpeg.read(media)) == raw
        done += 1
    assert done


@pytest.mark.parametrize("cut", [0, 40])
def test_tag_after_the_last_frame_is_a_tag(cut):
    media = mpeg.write(bytes(6400))
    tag = b"TAG" + b"A title".ljust(30, b"\0") + bytes(95)
    plain, tagged = mpeg.read(media[: len(media) - cut]), mpeg.read(media[: len(media) - cut] + tag)
    assert tagged.tags["title"] == "A title"
    assert (tagged.offsets, tagged.skipped) == (plain.offsets, plain.skipped)
