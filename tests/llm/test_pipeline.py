import pathlib
import random
import re

import corpus_pipeline
import numpy as np

from pyspark.sql import functions as F

from plumbline.llm import decontam, packing, pii, simhash, toxicity
from plumbline.llm.common import written

from .test_simhash import brute_components, brute_fingerprint
from .test_text_operators import brute_contaminated


def _tables(spark, folder):
    rng = random.Random(21)

    def prose(n):
        return " ".join(rng.choice("ba co di fu ge hi jo ku".split()) + rng.choice("na re ti lo".split()) + rng.choice(["", "s", "n", "x"]) for _ in range(n))

    texts, toxic = [], []
    for i in range(260):
        bad = i % 5 == 0
        t = prose(60).split()
        if bad:
            for w in ("grob", "vile", "muck", "zonk"):
                t[rng.randrange(60)] = w
        texts.append(" ".join(t))
        toxic.append(int(bad))
    items = [prose(30) for _ in range(4)]
    texts += [texts[1], texts[1], texts[2] + " tail", prose(20) + ". " + items[0], "write to a@b.co or +1 (017) 555-7713 " + prose(30), None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, toxic, dict(enumerate(items))


def test_stages_against_plain_ones(spark, tmp_path):
    texts, toxic, items = _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash near-dedup", "decontamination", "pii", "packing"]

    kept = stages["toxicity"](spark, docs, str(tmp_path))
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and ids == {i for i, t in enumerate(texts) if model.score(t) < 0.5}
    assert len(ids & {i for i, y in enumerate(toxic) if y}) <= 3 and len(ids & {i for i, y in enumerate(toxic) if not y}) >= 205

    once = stages["simhash near-dedup"](spark, kept, str(tmp_path))
    classes = brute_components({i: brute_fingerprint(texts[i]) for i in ids})
    assert once.columns == columns and {r.doc_id for r in once.collect()} == set(classes.values())

    clean = stages["decontamination"](spark, once, str(tmp_path))
    bad = {d for d, *_ in brute_contaminated({i: texts[i] for i in set(classes.values())}, items)}
    left = {r.doc_id: r.text for r in clean.collect()}
    assert 263 in bad and clean.columns == columns and set(left) == set(classes.values()) - bad

    masked = stages["pii"](spark, clean, str(tmp_path))
    assert masked.columns == columns and {r.doc_id: r.text for r in masked.collect()} == {i: pii.masked(t) for i, t in left.items()}

    packed = stages["packing"](spark, masked, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left)
    plain, _ = packing.best_fit(np.array([r.length for r in packed]))  # all pieces in one group
    assert len({r.sequence_id for r in packed}) <= plain.max() + 2

    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
    assert decontam.WINDOW == 5 and simhash.RADIUS == 2


def test_columns_of_any_name_go_through(spark, tmp_path):
    """Every name that the operators use inside, and one with a dot, as a column of documents."""
    _tables(spark, str(tmp_path))
    code = " ".join(p.read_text() for p in pathlib.Path(pii.__file__).parent.glob("*.py"))
    names = sorted({n.lower() for n in re.findall(r"\"([A-Za-z_]\w*)\"", code)} - {"doc_id", "text", "lang", "source", "n_chars"})
    assert {"__id", "__hash", "__evidence", "__told", "root", "fp"} <= set(names)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    more = [F.lit(k).alias(n) for k, n in enumerate([*names, "a.b", "__score", "__toxic"])]
    plain, wide = docs.where("doc_id % 3 = 0 OR doc_id > 250"), docs.where("doc_id % 3 = 0 OR doc_id > 250").select("*", *more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = (written(stage(spark, d, str(tmp_path)), "stage") for d in (plain, wide))
        assert wide.columns == [*plain.columns, *names, "a.b", "__score", "__toxic"]
        own = [F.col(c) for c in plain.columns]
        assert sorted(map(tuple, wide.select(*own).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        assert wide.select(*[F.col(f"`{c}`") for c in wide.columns[len(plain.columns) :]]).distinct().count() == 1
    packed = [sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()) for d in (plain, wide)]
    assert packed[0] == packed[1]
