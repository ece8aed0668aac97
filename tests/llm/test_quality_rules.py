import re
from collections import Counter

from conftest import SMALL

from salesengine.llm import queries, quality_rules
from salesengine.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    base = (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(repeated),
    )
    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
    kept = not failed and not any(r.rejects(quality_rules.Text(text)) for r in quality_rules.RULES)
    return (*base, failed, kept)


def rows(df):
    return sorted(tuple(r[n] for n in quality_rules.NAMES) for r in df.collect())


def test_query_like_plain_python(spark):
    docs = table(spark, SMALL, "documents").collect()
    assert rows(queries.op3_quality_rules(spark, SMALL)) == sorted((r.doc_id, *plain(r.text)) for r in docs)


def test_odd_texts(spark):
    words = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", "\x1c\x85", "a\x0bb\x0cc\rd", words, words, f"{words}\n{words}", "é " * 60, "x" * 300_000]
    texts += [words + " ###" * 40, "a b c " * 10_000, f"{words} " + " ".join("GOOD WORDS ARE HERE".split() * 2)]
    docs = spark.createDataFrame(
        [(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean"
    )
    assert rows(quality_rules.judge(docs)) == [(i, *plain(t)) for i, t in enumerate(texts)]
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if plain(t)[-1]]


def test_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], schema)
    assert [r.n_words for r in quality_rules.judge(docs).collect()] == [2, 2]
    empty = spark.createDataFrame([], schema)
    assert quality_rules.judge(empty).collect() == quality_rules.keep(empty).collect() == []


def test_order_follows_rejections_per_second():
    def slow(t):
        return sum(range(20_000)) < 0

    rules = [
        quality_rules.Rule("slow", slow),
        quality_rules.Rule("never", lambda t: False),
        quality_rules.Rule("often", lambda t: t.text < "5"),
    ]
    cascade = quality_rules.Cascade(rules, 20)
    first = [cascade.rejects(quality_rules.Text(str(i % 10))) for i in range(20)]
    assert [r.name for r in cascade.rules][0] == "often" and cascade.rules[-1].name == "slow"
    later = [cascade.rejects(quality_rules.Text(str(i % 10))) for i in range(20)]
    assert first == later == [i % 10 < 5 for i in range(20)]


def test_order_follows_all_documents():
    """Not only the first: what rejects those need not reject the rest."""
    rules = [
        quality_rules.Rule("early", lambda t: t.text == "a"),
        quality_rules.Rule("late", lambda t: t.text == "b"),
    ]
    cascade = quality_rules.Cascade(rules, 20)
    texts = ["a"] * 20 + ["b"] * 2_000 + ["c"]
    assert [cascade.rejects(quality_rules.Text(t)) for t in texts] == [True] * 2_020 + [False]
    assert [r.name for r in cascade.rules] == ["late", "early"]
    assert cascade.met == 2_021 and sum(cascade.rejected.values()) == 2 + 2_020


def test_no_period_keeps_the_order():
    rules = [quality_rules.Rule("never", lambda t: False), quality_rules.Rule("ever", lambda t: True)]
    cascade = quality_rules.Cascade(rules, 0)
    assert all(cascade.rejects(quality_rules.Text("a")) for _ in range(100))
    assert [r.name for r in cascade.rules] == ["never", "ever"]
    assert not quality_rules.Cascade([], 20).rejects(quality_rules.Text("a"))


def test_labels_agree(spark):
    """Hardly a document labelled good is rejected but for the base, and no bad one stays."""
    judged = queries.op3_quality_rules(spark, SMALL.replace("0.001", "0.01"))
    labels = table(spark, SMALL.replace("0.001", "0.01"), "labels").dropDuplicates(["doc_id"])
    both = judged.join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in both if r.quality == 1], [r.kept for r in both if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.02 * len(bad)
