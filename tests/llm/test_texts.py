"""SentencePiece, license, personal-data and WARC operators."""

import hashlib
import io
import random
import re
from collections import Counter

import pytest

from cairn.llm import licenses, pieces, private, warc

from .data import rows, table


def test_pieces_have_parity_and_round_trip(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(table(spark), keep=("source",)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in rows())
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert pieces.encode(table(spark, [])).count() == 0


def test_every_text_is_verified_beyond_the_sample():
    import sentencepiece
    data = open(pieces.MODEL, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["a" + " " * k + "b" for k in range(100)] + [" " * k for k in range(60)]
    texts += ["▁" * k + " a▁ ▁b" + " " * k for k in range(50)]
    texts += ["def f():\n" + " " * 24 + "return  1\n" + "\t" * 9 + " " * 31 + "# é\x00漢字 ", "plain words only", ""]
    ids, _, seen = pieces.encode_texts(data, texts, parity_bytes=0)
    assert ids == sp.encode(texts) and all(seen)
    assert ids == [pieces.encode_texts(data, [x], parity_bytes=0)[0][0] for x in texts]   # whatever the batch


def test_a_wrong_rebuild_is_noticed_in_any_text(monkeypatch):
    import sentencepiece
    data = open(pieces.MODEL, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    merges = pieces._merges
    monkeypatch.setattr(pieces, "_merges", lambda m: merges(m)[::-1])
    monkeypatch.setattr(pieces, "_BUILT", {})
    texts = [r[1] or "" for r in rows()] + ["the last one is wrong too"]
    ids, _, seen = pieces.encode_texts(data, texts, parity_bytes=0)
    assert ids == sp.encode(texts) and all(seen)


def test_pieces_decode(spark):
    texts = ["a  b\n\nc", "日本語 🎉 x", "", None, "<s> </s> <0x0A> ▁"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(d)).collect()}
    assert back == {0: texts[0], 1: texts[1], 2: "", 3: "", 4: "<s> </s> <0x0A>  "}


def test_odd_strings_have_parity():
    import sentencepiece
    data = open(pieces.MODEL, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(3)
    texts = ["".join(rng.choice(" ab\n▁éß🎉\x00<s>") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    ids, _, _ = pieces.encode_texts(data, texts, parity_bytes=0)
    assert ids == sp.encode(texts)


def _message(fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    return b"".join(varint(k << 3 | t) + (varint(v) if t == 0 else v if t == 5 else varint(len(v)) + v) for k, t, v in fields)


def test_unigram_model_with_normaliser_is_rebuilt():
    import struct

    import sentencepiece
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    vocab += [("▁", -2.0, 1), ("▁th", -2.5, 1), ("the", -3.0, 1), ("e", -4.0, 1), ("t", -4.1, 1), ("h", -4.2, 1), ("▁the", -3.3, 1)]
    parts = [(1, 2, _message([(1, 2, p.encode()), (2, 5, struct.pack("<f", s)), (3, 0, k)])) for p, s, k in vocab]
    spec = [(2, 2, _message([(3, 0, 1), (35, 0, 1)])), (3, 2, _message([(1, 2, b"identity"), (3, 0, 1), (4, 0, 1), (5, 0, 1)]))]
    data = _message(parts + spec)
    m = pieces.parse_model(data)
    assert (m.kind, m.byte_fallback, m.squeeze) == (pieces.UNIGRAM, True, True)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the the", "  the   e ", "ththe", "tée", ""]
    ids, back, _ = pieces.encode_texts(data, texts, parity_bytes=0)
    assert ids == sp.encode(texts) and all(back)


def plain_license(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    at = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            ",".join(sorted({x for _, x in at})))


def test_licenses_match_plain_phrases(spark):
    extra = ["CC-BY 4.0, cc by cc by; General  Public\nLicense. All rights reserved", "ccby general public licenses",
             "É cc by ü", "all rights reserved all rights reserved", "x" * 100_000 + " cc by"]
    data = rows() + [(100 + i, t, *[None] * 7) for i, t in enumerate(extra)]
    got = licenses.scan(table(spark, data)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == \
        Counter((r[0], *plain_license(r[1])) for r in data)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(table(spark, [])).count() == 0


@pytest.mark.parametrize("text, label, absent", [
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2-or-later", "gpl-2"),
    ("Licensed under the Apache License, Version 2.0 (the", "apache-2-0", "apache"),
    ("under CC BY-NC-SA 4.0 terms", "cc-by-nc-sa-4-0", "cc-by-nc"),
    ("GNU Lesser General Public License version 2.1 only", "lgpl-2-1-only", "lgpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit", "permissive"),
    ("a plain sentence about nothing", "", "mit")])
def test_license_signatures(text, label, absent):
    labels = licenses.scan_text(text)[5].split(",")
    assert label in labels and absent not in labels


def test_license_rules_are_hundreds_and_ordered():
    s = licenses.signatures()
    assert len(s) > 300 and [x.priority for x in s] == sorted((x.priority for x in s), reverse=True)


RE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
      "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_private(text):
    out = {}
    for kind, pattern in RE.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                  or kind == "card" and 13 <= len(d) <= 19 and private.luhn(d) or kind == "phone" and 9 <= len(d) <= 15)
            if ok:
                out[kind].append(m.span())
    return out


def test_private_base_spans_match_the_expressions(spark):
    rng = random.Random(5)
    odd = ["".join(rng.choice("a.b@@+1234567890 ()-.@x.é\n") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    odd += ["mail a.b@c.de, x@y@z.org 1.2.3.4.5.6.7.8 999.1.1.1 004.0255.1.1 4111 1111 1111 1111 +49 (0)30 123-4567 x",
            "é 12@3.4 +1-2-3-4-5-6-7-8-9 " * 3, "4" * 5000]
    data = rows() + [(100 + i, t, *[None] * 7) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in private.find(table(spark, data)).collect() if r.doc_id is not None}
    for r in data:
        if r[0] is None:
            continue
        want, g = plain_private(r[1]), got[r[0]]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(len(want[k]) for k in RE)
        text = ",".join(f"{k}:{a}:{b}" for k in RE for a, b in want[k])
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and g.spans.startswith(text)
    assert private.find(table(spark, [])).count() == 0


@pytest.mark.parametrize("text, kind, span", [
    ("see https://user@host.example.com:8080/a?b=c). Next", "url", "https://user@host.example.com:8080/a?b=c"),
    ("IBAN: DE89 3704 0044 0532 0130 00 thanks", "iban", "DE89 3704 0044 0532 0130 00"),
    ("account no. 12-3456-789 today", "account", "12-3456-789"),
    ("ask @some_one now", "handle", "@some_one")])
def test_private_own_kinds(text, kind, span):
    found = private.spans_of(text)[kind]
    assert [text[a:b] for a, b in found] == [span]


def test_private_leaves_prose_alone():
    assert not any(private.spans_of("By the account of many, an accountant +/- 3 @ home www. and http:// alone.").values())


PAGES = "page_id long, url string, html string, payload string, first string"


def test_warc_roundtrip_in_chunks(spark, tmp_path):
    body = "é" * 700
    data = [(1, "http://a", body), (2, None, body), (9, "http://c", body), (3, "x y", "short"), (4, "u", "short"), (5, "u", None),
            (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 400), (None, "u", body), (8, "u", "q" * 100_000)]
    d = spark.createDataFrame([(*r, "p", "f") for r in data], PAGES)
    folder = str(tmp_path / "w")
    warc.write(warc.roles(d), folder, chunk=1000, archive_bytes=20_000)
    table_ = warc.read(spark, folder, read_bytes=333)
    got = {r.page_id: r for r in warc.records_of(table_).collect()}
    assert set(got) == {r[0] for r in data}
    for i, _, h in data:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        again = h == body and i != 9
        assert got[i].record_type == ("revisit" if again else "response") and got[i].refers_to == (9 if again else None)
    chunks = warc.payloads(table_).collect()
    for i, _, h in data:
        parts = sorted((r.chunk_no, bytes(r.bytes)) for r in chunks if r.page_id == i)
        assert b"".join(b for _, b in parts) == (h or "").encode()
        assert all(len(b) <= 333 for _, b in parts)


def test_warc_of_nothing(spark, tmp_path):
    d = spark.createDataFrame([], PAGES)
    folder = str(tmp_path / "w")
    warc.write(warc.roles(d), folder)
    assert warc.records_of(warc.read(spark, folder)).count() == 0


def test_warc_damage_is_noticed():
    good = warc.header(1, "u", 3, "x", "response", None, 3) + b"abc" + warc.END
    assert [x[2] for x in warc.chunks_of(io.BytesIO(good + good), 2)] == [b"ab", b"c"] * 2
    for bad in (good[:-6], good.replace(b"Length: 3", b"Length: 2"), b"x" + good):
        with pytest.raises(ValueError):
            list(warc.chunks_of(io.BytesIO(bad), 2))


# ---- linear sweeps against plain ones, and very long texts -------------------------------


def plain_detections(line):
    """Every rule tried on the line, offsets counted from its start, suppression by comparing with all before."""
    found = []
    for s in licenses.signatures():
        if s.keyword in line:
            for m in s.pattern.finditer(line):
                start = line[:m.start()].count(b" ") - 1
                found.append((start, start + m.group().count(b" ") + 1, s.label, s.priority))
    taken = []
    for x in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
        if not any(t[0] <= x[0] and x[1] <= t[1] for t in taken):
            taken.append(x)
    return taken


def test_license_sweep_matches_a_plain_scan():
    import random
    rng = random.Random(8)
    phrases = ["licensed under the apache license version 2 0", "apache license", "mit license", "cc by sa 4 0", "cc by", "gpl v3",
               "gnu general public license v2 or later", "spdx license identifier mit", "all rights reserved", "public domain",
               "copyright c 2019 2020", "bsd 3 clause", "redistribution prohibited", "the", "word", "lgpl 2 1"]
    for _ in range(60):
        line, n = licenses.line_of(" ".join(rng.choice(phrases) for _ in range(rng.randint(0, 60))))
        assert licenses.detections(line) == plain_detections(line)
        for phrase, _ in licenses.BASE:
            p = b" " + phrase.encode() + b" "
            want = [i for i, w in enumerate(line.split()) if line.split()[i:i + len(phrase.split())] == phrase.encode().split()]
            assert licenses.places(line, p) == want


def test_very_long_texts_full_of_hits_end_in_seconds():
    import time
    for scan, unit in ((licenses.scan_text, "Licensed under the Apache License, Version 2.0; cc by all rights reserved. "),
                       (private.spans_of, "bob@x.com @alice_b 10.0.0.1 +49 30 1234567 ftp://a.b/c DE89 3704 0044 0532 0130 00 ")):
        start = time.time()
        scan(unit * (2_000_000 // len(unit)))
        assert time.time() - start < 60


def test_iban_without_a_cue():
    text = "pay to DE89 3704 0044 0532 0130 00 or iban: GB82WEST12345698765432, not XX00 1234 nor ADE89370400440532013000"
    found = [text[a:b] for a, b in private.spans_of(text)["iban"]]
    assert found == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
