import hashlib
import random
import re

from conftest import SMALL
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from salesengine.llm import bpe, quality_rules, queries, secret_scan
from salesengine.llm.common import stored, table


def test_like_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    passed = []
    for i, text in docs:
        t = quality_rules.Text(text)
        if not quality_rules.base_failed(t) and not any(r.rejects(t) for r in quality_rules.RULES):
            passed.append((i, text))
    prints = [(i, plain_fingerprint(t)) for i, t in passed]
    kept = [d for d, c in zip(passed, plain_components(prints, 3)) if d[0] == c]
    frame = spark.createDataFrame(kept, "doc_id long, text string")
    model = secret_scan.train(frame)
    encoder = bpe.Encoder(queries.tokenizer_path())
    want = {}
    for i, text in kept:
        ids = encoder.library([secret_scan.masked(text, model).encode()])[0]
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest())
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in out} == want and len(out) == len(want)


def stages(spark, docs):
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SMALL)))
    return frames


def test_stages_keep_the_columns(spark):
    docs = table(spark, SMALL, "documents")
    *kept, last = stages(spark, docs)
    assert all(f.schema == docs.schema for f in kept) and last.columns[0] == "doc_id"
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules",
        "simhash_near_duplicates",
        "secret_scan",
        "mixing",
        "bpe",
    ]
    for row in kept[3].collect():
        assert row.n_chars == len(row.text) and not re.search("AKIA[A-Z0-9]{16,}", row.text)


def test_odd_rows_pass_all_stages(spark):
    text = " ".join(f"word{i} and" for i in range(90)) + "."
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, fp long, position string, "
        "keeper int, row binary, copies int"
    )
    rows = [(1, text), (1, text), (2, text.replace("and", "And")), (None, text + " more"), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "p", 2, b"r", 3) for i, t in rows], schema)
    frames = stages(spark, docs)
    assert [f.count() for f in frames] == [7, 4, 2, 2, 2, 2]
    assert all(f.schema == docs.schema for f in frames[:-1])
    assert stages(spark, docs.limit(0))[-1].collect() == []


def plain_mix(sources):
    """Ids in the order of the mix, from id and source, slot by slot."""
    left = {}
    for i in sorted(sources, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        left.setdefault(sources[i], []).append(i)
    names = sorted(left)
    weights = [queries.MIX_WEIGHTS.get(n, 1) for n in names]
    slots, done, order, slot = sum(weights), [0] * len(names), [], 0
    while len(order) < len(sources):
        due = [(-(-(d + 1) * slots // w), k) for k, (d, w) in enumerate(zip(done, weights)) if d * slots // w <= slot]
        k = min(due)[1]
        order += left[names[k]][done[k] * queries.MIX_BLOCK : (done[k] + 1) * queries.MIX_BLOCK]
        done[k] += 1
        slot += 1
    return order


def test_positions_are_those_of_the_mix(spark):
    sources = {r.doc_id: r.source for r in table(spark, SMALL, "documents").collect()}
    out = corpus_pipeline.run(spark, SMALL).orderBy("position").collect()
    assert [r.position for r in out] == list(range(len(out)))
    assert [r.doc_id for r in out] == plain_mix({r.doc_id: sources[r.doc_id] for r in out})


def test_positions_of_repeated_rows_and_of_many_files(spark, tmp_path):
    text = " ".join(f"word{i} and" for i in range(2_000))
    rows = [(i % 3 or None, f"{text} {i % 5}", "p") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, position string")
    frame.repartition(7).write.option("maxRecordsPerFile", 4).parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    placed = corpus_pipeline.mixing.file_positions(docs)
    assert placed.columns == docs.columns
    encoder = bpe.Encoder(queries.tokenizer_path())
    ids = {t: encoder.library([t.encode()])[0] for t in {t for _, t, _ in rows}}
    at = {r.position: (r.doc_id, hashlib.sha256(ids[r.text]).hexdigest()) for r in placed.collect()}
    assert sorted(at) == list(range(60))
    read = sorted((f.name.split("-")[1], f.name.split("-c")[1], str(f)) for f in (tmp_path / "docs").glob("part-*"))
    assert len(read) >= 14
    in_files = [r for f in read for r in spark.read.parquet(f[2]).collect()]
    assert [at[i][0] for i in range(60)] == [r.doc_id for r in in_files]
    out = corpus_pipeline.encoded(spark, docs.drop("position"), SMALL).collect()
    assert {r.position: (r.doc_id, r.ids_sha256) for r in out} == at and len(out) == 60


def test_secrets_are_learned_from_all_findings(spark, monkeypatch):
    """More findings of a label than were once drawn, and longer ones."""
    rng = random.Random(21)
    texts = [f"und der {rng.randrange(10**15, 10**16)}-nr call" for _ in range(3_600)]
    texts += [f"the key token = {rng.getrandbits(160):040x}{'ab' * (i % 2 * 150)} end" for i in range(3_600)]
    schema = "doc_id long, text string, n_chars long"
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], schema)
    models = []
    mask = secret_scan.mask
    monkeypatch.setattr(secret_scan, "mask", lambda d, model, **k: (models.append(model), mask(d, model, **k))[1])
    out = corpus_pipeline.secrets(spark, docs, "").collect()
    assert len(out) == 7_200
    assert models[0].fitted + models[0].held == 7_200
    masked = {r.doc_id: r.text for r in out}
    assert all("[SECRET]" in masked[i] for i in range(3_600, 7_200))
    assert sum("[SECRET]" in masked[i] for i in range(3_600)) <= 36


def test_quality_rules_are_ordered_by_all_documents(spark, tmp_path, monkeypatch):
    """A rule that rejects the first documents of a task only is hardly asked of the others."""
    asked = tmp_path / "asked"

    def early(t):
        with open(asked, "a") as f:
            f.write(".")
        return t.words[0] == b"early"

    rules = (quality_rules.Rule("early", early), quality_rules.Rule("late", lambda t: t.words[0] == b"late"))
    words = " ".join(f"word{i}" for i in range(80))
    texts = [f"early {words}"] * 200 + [f"late {words}"] * 3_000 + [words] * 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    keep = quality_rules.keep
    monkeypatch.setattr(quality_rules, "keep", lambda d: keep(d, rules))
    out = stored(corpus_pipeline.quality(spark, docs, ""))
    assert sorted(r.doc_id for r in out.collect()) == list(range(3_200, 3_210))
    assert len(asked.read_text()) <= 1_500
