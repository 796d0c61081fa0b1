"""Registered queries against plain Python over the smallest tables."""

import hashlib
import zlib

import pytest

from parlance.llm import langid, mpeg_audio, queries, token_counts

from . import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_op9_columns(spark, docs):
    """Frames of 672 bytes follow the tag; the first holds the table, and each other one 576 payload bytes from its 24th on."""
    media = {r.doc_id: bytes(r.media) for r in mpeg_audio.media_table(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    got = {r.doc_id: r for r in queries.op9_mpeg_audio(spark, SF).collect()}
    assert set(got) == {d.doc_id for d in docs}
    features = {}
    for d in docs:
        raw, stored, r = (d.text or "").encode(), media[d.doc_id], got[d.doc_id]
        start = 10 + sum((b & 127) << s for b, s in zip(stored[6:10], (21, 14, 7, 0), strict=True)) + 672
        payload = b"".join(stored[at + 23 : at + 599] for at in range(start, len(stored), 672))
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert payload == want
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(want[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.frames, r.duration_us, r.crc_failed) == (len(want) // 576, len(want) // 576 * 24_000, 0)
        assert features.setdefault(want, r.feature) == r.feature


def test_op3_counts(spark, docs):
    pieces = {*token_counts.read_vocabulary(token_counts.default_path()), *(bytes([b]) for b in range(256))}
    longest, known = max(map(len, pieces)), {}

    def greedy(word):
        if word not in known:
            n, rest = 0, token_counts.MARK + word
            while rest:
                rest = rest[next(k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in pieces) :]
                n += 1
            known[word] = n
        return known[word]

    got = {r.doc_id: (r.n_words, r.n_pieces) for r in queries.op3_token_counts(spark, SF).collect()}
    for d in docs:
        words = (d.text or "").encode().split()
        assert got[d.doc_id] == (len(words), sum(map(greedy, words)))


def test_op8_predictions(spark, docs):
    model, texts = plain.Languages([(d.doc_id, d.text, d.lang) for d in docs]), {d.doc_id: d.text for d in docs}
    for r in queries.op8_language_id(spark, SF).collect():
        best, cosine = model.guess(texts[r.doc_id])
        assert r.held_out == (plain.fold(r.doc_id, 4) == 2)
        assert r.lang_pred == (best or "und") and r.score == pytest.approx(max(0, cosine), abs=1e-5)


def test_op2_scores(spark, docs):
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = dict(zip([d.doc_id for d in docs], plain.toxic_scores([(d.doc_id, d.text) for d in docs], labels), strict=True))
    got = queries.op2_toxicity(spark, SF).collect()
    assert {r.doc_id for r in got} == set(want) and any(r.predicted for r in got)
    for r in got:
        assert r.held_out == (plain.fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5)
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9)


def test_op10_copies(spark, docs):
    got = {r.doc_id: r.copies for r in queries.op10_mixing(spark, SF).collect()}
    assert got == dict(zip([d.doc_id for d in docs], plain.copies([(d.doc_id, d.text, d.source) for d in docs]), strict=True))


def test_many_languages_take_several_passes(spark, monkeypatch):
    rounded = lambda: sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in queries.op8_language_id(spark, SF).collect())
    want = rounded()
    monkeypatch.setattr(langid, "PART_LANGS", 1)
    monkeypatch.setattr(langid, "HELD_LANGS", 1)
    assert rounded() == want


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


def plain_crc(bits):
    x = 0xFFFF
    for b in bits:
        x = (x << 1 & 0xFFFF) ^ (0x8005 if (x >> 15) ^ int(b) else 0)
    return x


@pytest.mark.parametrize(("word", "covered"), [
    (b"\xff\xfe\x40\xc0", 128),  # Layer I, mono: 32 allocations of four bits
    (b"\xff\xfe\x40\x00", 256),  # Layer I, two channels
    (b"\xff\xfe\x40\x50", 160),  # Layer I, joint from subband 8 on
    (b"\xff\xfc\x84\xc0", 88 + 2 * 3),  # Layer II, 128 kbit/s, 48 kHz, mono: 27 subbands, three with samples
])
def test_checksums_of_other_layers(word, covered):
    h = mpeg_audio.parse_header(word)
    body = bytearray(h.length - 6)
    if h.layer == 2:
        body[0] = 0x11  # subbands 0 and 1
        body[5] = 0b00000010  # subband 11, whose three bits start at bit 44
    else:
        body[3], body[9] = 0x5A, 0xC3
    crc = plain_crc(bits_of(word[2:]) + bits_of(body)[:covered])
    frame = word + crc.to_bytes(2, "big") + bytes(body)
    s = mpeg_audio.read_stream(frame * 3)
    assert (len(s.offsets), s.checked, s.failed) == (3, 3, 0)
    assert mpeg_audio.read_stream((word + (crc ^ 1).to_bytes(2, "big") + bytes(body)) * 3).failed == 3


def test_tag_flags():
    frame = mpeg_audio.write_stream(mpeg_audio.padded(b"x"), 1)
    frames = frame[10 + sum((b & 127) << s for b, s in zip(frame[6:10], (21, 14, 7, 0), strict=True)) :]
    text = b"\x00a\xff\xe0b"
    plain = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    synced = plain.replace(b"\xff", b"\xff\0")
    size = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    extended = b"\0\0\0\x06" + bytes(6)
    for head in (b"ID3\x03\0\x80" + size(len(synced)) + synced, b"ID3\x03\0\x40" + size(len(extended + plain)) + extended + plain, b"ID3\x04\0\x10" + size(len(plain)) + plain + b"3DI\x04\0\x10" + size(len(plain))):
        s = mpeg_audio.read_stream(head + frames)
        assert s.tags["TIT2"] == "aÿàb" and s.skipped == 0 and len(s.offsets) == 1 and s.offsets[0] == len(head) + 672
