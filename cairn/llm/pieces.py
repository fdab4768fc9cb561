"""SentencePiece encoding and decoding through the tokenizers library.

A ``.model`` file is a protobuf: :func:`parse_model` reads its pieces, scores, types and
normaliser, :func:`build` makes a ``tokenizers`` pipeline from them (normaliser, metaspace
marker, unigram scores or merges ranked by score, byte fallback), and :func:`encode` runs it in
batches over several threads. Where ``sentencepiece`` is installed, parity with it is verified
for every text, and a text that differs is returned as the original library encodes it. Where no
piece has a space mark behind another character, merges never leave a word (a run of marks and
what follows up to the next run), so the original library's tokens of a text are those of its
words one after the other: it encodes every distinct word once, and their ids joined are compared
with the text's. Texts of other models are encoded whole by both libraries; so are, besides, the
first ``parity_bytes`` characters of texts of each batch.

Defined results: NULL and empty texts give no tokens; special tokens' strings in a text are
ordinary text; a text is encoded whole, whatever its length; rows are independent, repeated
rows give equal results; an empty table gives an empty table; other columns are ignored.
``round_trip`` tells whether decoding the ids gives the normalised text again.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
THREADS = 2
BATCH_BYTES = 1 << 20
PARITY_BYTES = 1 << 15
KNOWN_WORDS, KNOWN_CHARS = 1 << 19, 64   # words whose ids a worker holds from batch to batch, and their length


@dataclass
class Model:
    pieces: list = field(default_factory=list)
    scores: list = field(default_factory=list)
    types: list = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(buf: bytes):
    """(field number, value) of one protobuf message: ints for varints, bytes otherwise."""
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(buf, at)
        else:
            if kind == 2:
                size, at = _varint(buf, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value, at = buf[at:at + size], at + size
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append(piece), m.scores.append(score), m.types.append(kind)
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m


def _merges(m: Model) -> list:
    """Every way to join two pieces into a third, best score of the result first."""
    own = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t == NORMAL}
    found = []
    for piece, i in own.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if a in own and b in own:
                found.append((-m.scores[i], own[a], own[b], a, b))
    found.sort()
    return [(a, b) for *_, a, b in found]


def build(m: Model):
    """A ``tokenizers.Tokenizer`` that encodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers
    unk = m.types.index(UNKNOWN) if UNKNOWN in m.types else None
    if m.kind == UNIGRAM:
        model = models.Unigram(list(zip(m.pieces, m.scores)), unk, m.byte_fallback)
    elif m.kind == BPE:
        model = models.BPE({p: i for i, p in enumerate(m.pieces)}, _merges(m), fuse_unk=True,
                           unk_token=None if unk is None else m.pieces[unk], byte_fallback=m.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    t.add_tokens([AddedToken(p, normalized=True) for p, k in zip(m.pieces, m.types) if k == USER_DEFINED])
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                  + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return t


_BUILT: dict = {}


def _backend(data: bytes):
    """The tokenizer, the original library's processor and its ids of words (None: texts are compared
    whole) of a worker, made once."""
    key = hash(data)
    if key not in _BUILT:
        processor = None
        try:
            import sentencepiece
            processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        except ImportError:
            pass
        m = parse_model(data)
        _BUILT[key] = (m, build(m), processor, _plain(m),
                       {"": array("i", [m.pieces.index(MARK)]).tobytes()} if _by_words(m) else None)
    return _BUILT[key]


def _normal(m: Model, t, text: str) -> str:
    """What decoding should give: the text as the model sees it."""
    if not m.charsmap and not m.squeeze:
        return text
    shown = t.normalizer.normalize_str(text).replace(MARK, " ")
    return shown[1:] if m.dummy_prefix and shown.startswith(" ") else shown


def _plain(m: Model) -> list:
    """What each piece stands for by itself; None for a byte that needs its neighbours."""
    return [(chr(int(p[3:5], 16)) if int(p[3:5], 16) < 128 else None) if k == BYTE
            else None if k in (UNKNOWN, CONTROL) else p.replace(MARK, " ")
            for p, k in zip(m.pieces, m.types)]


def _shown(m: Model, t, plain: list, ids: list) -> str:
    """The decoded text: the pieces joined, or the library's decoder where bytes must be put
    together."""
    parts = [plain[i] for i in ids]
    if None in parts:
        return t.decode(ids, skip_special_tokens=False)
    text = "".join(parts)
    return text[1:] if m.dummy_prefix and text.startswith(" ") else text


def _by_words(m: Model) -> bool:
    """Whether a text's tokens are its words' tokens: only the space is rewritten, every text starts
    with a mark, and no piece goes on into the next word."""
    return (m.kind == BPE and m.dummy_prefix and m.escape and not m.squeeze and not m.charsmap
            and set(m.types) <= {NORMAL, UNKNOWN, CONTROL, BYTE} and (MARK, NORMAL) in zip(m.pieces, m.types)
            and not any(k == NORMAL and re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(m.pieces, m.types)))


def _words(text: str) -> list:
    """The words of a text in order, each without its first mark, which encoding puts back; the
    empty word is a mark alone at the end."""
    if not text:
        return []
    if "  " in text or MARK in text or text.startswith(" "):
        return [w[1:] for w in re.findall(f"[ {MARK}]+[^ {MARK}]*", " " + text)]
    return text.split(" ")


def _mend(processor, known: dict | None, texts: list, ids: list, parity_bytes: int) -> None:
    """Put the original library's ids in place of those that differ."""
    if known is None:
        again = range(len(texts))
    else:
        own = [_words(x) for x in texts]
        new = list(set().union(*own).difference(known))
        known.update((w, array("i", x).tobytes()) for w, x in zip(new, processor.encode(new, num_threads=1)))
        again, left = [], parity_bytes
        for i, x in enumerate(texts):
            if left > 0 or b"".join(map(known.__getitem__, own[i])) != array("i", ids[i]).tobytes():
                again.append(i)
            left -= len(x)
        if len(known) > KNOWN_WORDS:
            mark = known[""]
            known.clear()
            known[""] = mark
        else:
            for w in new:
                if len(w) > KNOWN_CHARS:
                    del known[w]
    for i in again:
        ids[i] = processor.encode(texts[i])


def encode_texts(data: bytes, texts: list, parity_bytes: int = PARITY_BYTES):
    """(ids, round trip holds, verified) of each text; one batch of the library."""
    m, t, processor, plain, known = _backend(data)
    texts = [x or "" for x in texts]
    ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    if processor is not None:
        _mend(processor, known, texts, ids, parity_bytes)
    return (ids, [_shown(m, t, plain, i) == _normal(m, t, x) for i, x in zip(ids, texts)],
            [processor is not None] * len(texts))


def decode_ids(data: bytes, ids: list) -> list:
    return _backend(data)[1].decode_batch([list(x) for x in ids], skip_special_tokens=False)


def _batches(frame, text: str):
    start = size = 0
    lengths = frame[text].str.len().fillna(0).to_numpy()
    for i, n in enumerate(lengths):
        size += int(n)
        if size >= BATCH_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(frame):
        yield start, len(frame)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text: str = "text", threads: int = THREADS,
           parity_bytes: int = PARITY_BYTES, keep: tuple = ()) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip, verified) and the columns ``keep``. ``model`` is a path on the driver; the
    file (a vocabulary, some hundred KB) goes along with the tasks."""
    ship_package(docs.sparkSession)
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(frames):
        import pandas as pd
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        for frame in frames:
            for a, b in _batches(frame, "text"):
                part = frame.iloc[a:b]
                ids, back, seen = encode_texts(data.value, part["text"].tolist(), parity_bytes)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": [len(x) for x in ids],
                                    "ids": ids, "round_trip": back, "verified": seen}
                                   | {c: part[c].to_numpy() for c in keep})

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *keep)
    kinds = dict(d.dtypes)
    return d.mapInPandas(run, f"doc_id {kinds['doc_id']}, n_tokens long, ids array<int>, round_trip boolean, "
                              "verified boolean" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from token ids; NULL ids give NULL."""
    ship_package(encoded.sparkSession)
    with open(model, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def back(column):
        import pandas as pd
        found = decode_ids(data.value, [[] if x is None else x for x in column])
        return pd.Series([None if x is None else t for x, t in zip(column, found)], index=column.index)

    return encoded.select(F.col(id_col).alias("doc_id"), back(F.col(ids)).alias("text"))


# ---- registered query (SQL has no tokenizer; tests compare with the original library) ----

def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
