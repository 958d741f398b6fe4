import re
from collections import Counter

from quadrille.llm import quality

from . import cases


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_statistics_against_brute_force(spark):
    got = quality.judged(cases.table(spark), []).collect()
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got]
    want = []
    for r in cases.rows():
        b = brute(r[1])
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        want.append((r[0], *b, failed, not failed))
    assert sorted(mine, key=key) == sorted(want, key=key)


def fake(n, bad):
    rows = []
    for i in range(n):
        r = dict.fromkeys(quality.FEATURES, 1.0) | {"doc_id": i, "n_words": 50 + i % 40, "quality": 1}
        if bad(i):
            r |= {"symbols_per_word": 1.5 + i % 7 / 10, "quality": 0}
        elif i % 11 == 5:
            r |= {"distinct_word_share": 0.1, "quality": 0}
        rows.append(r)
    return rows


def test_rules_are_learned_and_ordered(spark):
    rows = fake(300, lambda i: i % 5 == 0)
    rules = quality.learn_rules(rows)
    assert rules and all(1 <= len(r) <= 4 for r in rules)
    rejected = lambda r: any(all(t.holds(r) for t in rule) for rule in rules)
    assert all(rejected(r) == (r["quality"] == 0) for r in rows)
    frame = spark.createDataFrame([{k: float(v) if k in quality.FEATURES else v for k, v in r.items()} for r in rows])
    got = {r.doc_id: r.kept for r in frame.select("doc_id", quality.keeps(rules).alias("kept")).collect()}
    assert got == {r["doc_id"]: not rejected(r) for r in rows}


def test_noise_gives_no_rule():
    rows = [dict.fromkeys(quality.FEATURES, float(i % 3)) | {"doc_id": i, "quality": int(i * 7919 % 10 > 3)} for i in range(200)]
    assert quality.learn_rules(rows) == []
    assert quality.learn_rules([]) == []
    assert quality.learn_rules([r | {"quality": 1} for r in rows]) == []


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.labelled(cases.table(spark), labels) == []
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.labelled(cases.table(spark), labels)) == 6
    assert quality.judged(cases.empty(spark), []).count() == 0
    kept = quality.accepted(cases.table(spark), [])
    assert kept.columns == cases.table(spark).columns and kept.count() == sum(brute(r[1])[0] >= 10 and brute(r[1])[4] * 100 <= 20 * brute(r[1])[0] for r in cases.rows())


def test_plan_has_no_python(spark):
    plan = quality.judged(cases.table(spark), [])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
