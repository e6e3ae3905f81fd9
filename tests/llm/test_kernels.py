import zlib

import numpy as np

from papyra.llm import media, packing, urls, warc


def test_png_round_trip():
    n, payload = media.padded("ab")
    assert n == 2 and len(payload) == 192
    assert media.from_png(media.to_png(payload)).tobytes() == payload


def test_html_keeps_captions_aligned():
    items = media.parse_html("<p>a</p><figure><img src='x' alt='no'><figcaption>cap</figcaption></figure><p>b")
    assert [(i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [("text", "a", None, None), ("image", None, "x", "cap"), ("text", "b", None, None)]


def test_url_rules_and_words():
    by = urls.UrlFilter()
    assert by.judge("https://x.example.net/en/1")[2:4] == ("example.net/en/", "allow")
    assert by.judge("https://a.net/x")[2:4] == ("net/", "block")
    assert by.judge(None)[:4] == ("", "", None, "allow")
    assert by.judge("http://casino.example.com/")[3] == "block"
    assert by.judge("http://essex.example.com/")[3] == "allow"


def test_word_merges_equal_the_tokenizer():
    enc = packing.Encoder(None)
    words = ["hello", "the", "anredtion,", "über.", "x", "don't", "élle", "###a"]
    for w, ids in zip(words, enc.encode(words), strict=True):
        assert np.frombuffer(ids, dtype=enc.kind).tolist() == enc.tokenizer.encode(w, add_special_tokens=False).ids


def test_packing_loses_nothing():
    rng = np.random.default_rng(1)
    rests = [rng.integers(0, 50, n) for n in rng.integers(0, 200, 40)]
    seen = [0] * len(rests)
    for pieces in packing.pack(rests, 256):
        for d, a, b in pieces:
            assert a == seen[d]
            seen[d] = b
    assert seen == [len(r) for r in rests]


def test_false_magic_is_no_record():
    good = warc.member({"record_type": "response", "record_id": "urn:row:1", "payload": b"x" * 10, "payload_digest": "00", "target_uri": None, "refers_to": None})
    assert warc.is_member(good[: warc.HEAD]) and not warc.is_member(warc.MAGIC + b"junk" * 20)
    assert zlib.decompress(good, 31).startswith(b"WARC/1.1")
