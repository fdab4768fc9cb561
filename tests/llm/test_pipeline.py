"""The pipeline's stages against brute force, and the driver's contract."""

import re
from collections import Counter

import numpy as np

import __spark_entry__ as E
import corpus_pipeline as C
from cairn.llm import parity, pieces

from .data import table, words
from .test_models import brute_join, edited

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    texts = ["the " + words(150, i) + " of the end of the line" for i in range(40)]
    texts += [texts[0], texts[1].replace(" ", "\n"), edited(texts[2], 2, 1), edited(texts[2], 2, 2), "", None, "too short",
              "### $$$ " * 50, "a b c d e " * 40]
    return [(i, t, "en", f"s{i % 3}" if i % 2 else "hot", None) for i, t in enumerate(texts)]


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in C.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
    ids = [{r.doc_id for r in k} for k in kept]
    assert ids[0] == set(range(44))
    assert ids[1] == set(range(40)) | {42, 43}
    near = brute_join([(r.doc_id, r.text) for r in kept[1]], 5, 80)
    assert ids[2] == {c for _, _, c in near} and 42 not in ids[2] and 43 not in ids[2]
    assert ids[3] == ids[2] and len(kept[3]) == len(kept[2])
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {r.doc_id: list(r.ids) for r in kept[4]} == {r.doc_id: sp.encode(r.text) for r in kept[3]}


def test_mix_stage_keeps_all_rows_beside_a_tiny_source(spark):
    # 2,500 blocks of one source: a period has about 1,000 slots, and a source of one row ends in the second
    hot = spark.range(40_000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'hot' AS source", "id AS n_chars")
    docs = hot.unionByName(spark.createDataFrame([(-1, "t", "en", "one", 1), (-2, "t", "en", None, 1)],
                                                   "doc_id long, text string, lang string, source string, n_chars long"))
    out = C.source_mix(spark, docs, "")
    assert out.columns == COLUMNS
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter([-1, -2, *range(40_000)])


def test_run_on_the_smallest_table(spark):
    got = C.run(spark, "/root/testdata/sf0.001").collect()
    assert got and len({r.doc_id for r in got}) == len(got) and all(r.round_trip for r in got)


def test_empty_documents_pass_through(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    table(spark, []).select(*COLUMNS).write.parquet(path)
    assert C.run(spark, str(tmp_path)).count() == 0


def test_entry_has_every_operator():
    names = {m[0] for m in (re.match(r"op\d+_", k) for k in E.queries()) if m}
    assert names == {f"op{n}_" for n in range(1, 14)} and "pipeline" in E.queries()
    assert Counter(type(v) for v in E.oracle_sql().values()) == {str: len(E.oracle_sql())}
    assert parity.PERCENT == 85 and parity.WORDS == 4


def test_the_mix_decides_the_place_of_every_encoded_text(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "hot" if i % 9 else "few", i) for i in range(700)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    C.source_mix(spark, docs, "").write.parquet(str(tmp_path / "mix"))
    out = C.sentencepiece(spark, spark.read.parquet(str(tmp_path / "mix")), "").collect()
    mixed = C.pfair.mix(docs).orderBy("slot", "place").collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.place)] == [r.doc_id for r in mixed]
    assert sorted(r.place for r in out) == list(range(700))


def test_centres_meet_only_what_the_bounds_allow(spark):
    # 60 sets that share one frequent sketch and little else
    rows = [(7, n, n, 100, *[(n * 0x9E3779B97F4A7C15 * (i + 1)) % (1 << 62) for i in range(parity.FOLDED)]) for n in range(60)]
    rows += [(7, 100, 100, 100, *rows[3][4:]), (8, 100, 100, 100, *rows[3][4:]), (8, 3, 3, 100, *rows[3][4:])]
    schema = "key long, node long, label long, n long, " + ", ".join(f"p{i} long" for i in range(parity.FOLDED))
    got = parity._centred(spark.createDataFrame(rows, schema), C.pfair.F.col("node"), 80).collect()
    assert [(r.a, r.b) for r in got] == [(3, 100)]


def test_a_family_of_near_copies_makes_few_edges(spark, monkeypatch):
    # texts near the threshold: a star links some, and each of the others then has many links into one class
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for n in range(120):
        words = list(base)
        for i, at in enumerate(rng.choice(200, int(rng.integers(1, 5)), replace=False)):
            words[at] = f"x{n}y{i}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, found = [], parity.components
    monkeypatch.setattr(parity, "components", lambda links: (seen.append(links.count()), found(links))[1])
    got = {r.doc_id: r.component_id for r in parity.join(docs, words=5, percent=80).collect()}
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    label = list(range(120))
    for a in range(120):
        for b in range(a):
            if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert got == dict(enumerate(label))
    assert sum(seen) <= 2 * 120
