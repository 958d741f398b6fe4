import random
import re
import string

from quadrille.llm import secrets

from . import cases

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(t):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_patterns_against_brute_force():
    rng = random.Random(1)
    parts = ["password", "PassWd", "ſecret", "toKen", "api_KEY", "apikey", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "0123", "é", "x.y-z", "\n"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(t) == brute(t), t


def test_models_tell_random_from_ordinary(spark):
    models = secrets.train(cases.table(spark))
    rng = random.Random(4)
    for alphabet in (string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits):
        runs = ["".join(rng.choice(alphabet) for _ in range(28)) for _ in range(60)]
        assert sum(models.score(r) > models.threshold for r in runs) >= 56
    ordinary = ["getUserNameById2FromTable", "max_tokens_per_batch_v2", "IntegerOverflowException404", "com/example/project1/module2", "2024-01-15-release-notes-final"]
    assert all(models.score(r) < models.threshold for r in ordinary)


def test_scan_and_redaction(spark):
    docs = cases.table(spark)
    models = secrets.train(docs)
    rows = cases.rows()
    got = secrets.scan(docs, models).collect()
    assert len(got) == len(rows)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in got}
    for r in rows[:18]:
        assert [s for s in spans[r[0]] if s[0] != "markov"] == brute(r[1] or "")
    clean = secrets.redacted(docs, models)
    assert clean.schema == docs.schema
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[12].text == "[SECRET]\" and [SECRET]" and texts[12].n_chars == len(texts[12].text)
    assert all(texts[r[0]].text == r[1] for r in rows[:18] if not spans[r[0]])
    assert secrets.redacted(cases.empty(spark), secrets.train(cases.empty(spark))).count() == 0


def test_markov_spans_keep_off_base_spans(spark):
    models = secrets.train(cases.table(spark))
    t = "key Zx8Qw2LmN4vB7tYp1RsK6dHj and password=Zx8Qw2LmN4vB7tYp1RsK6dHj."
    base = secrets.base_spans(t)
    assert [s[0] for s in base] == ["assign"]
    assert [t[a:b] for _, a, b in models.spans(t, base)] == ["Zx8Qw2LmN4vB7tYp1RsK6dHj"]


def test_pieces_beside_base_spans_and_letters_only(spark):
    models = secrets.train(cases.table(spark))
    rng = random.Random(6)
    draw = lambda n, alphabet=string.ascii_letters + string.digits: "".join(rng.choice(alphabet) for _ in range(n))
    after, before, letters = draw(40), draw(24), draw(40, string.ascii_letters)
    access, hexes = "AKIA" + draw(16, string.ascii_uppercase + string.digits), draw(32, "abcdef0123456789")
    for t, want in ((f"a {access}/{after} b", [f"/{after}"]), (f"{before}Z{hexes}Z{after}", [before + "Z", "Z" + after]), (f"x {letters} y", [letters])):
        assert [t[a:b] for _, a, b in models.spans(t, secrets.base_spans(t))] == want
    for t in (f"objects/{hexes}/blob", f"md5={hexes}", "AbstractSingletonProxyFactoryBean and antidisestablishmentarianism"):
        assert models.spans(t, secrets.base_spans(t)) == []


def secret_corpus(n=400):
    """Prose with labelled secrets in every other text."""
    rng = random.Random(21)
    out = []
    for i in range(n):
        text = cases.prose(rng, 40) + " get_user_name max_tokens_per_batch IntegerOverflowException "
        if i % 2:
            value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24))
            text += rng.choice([f"password={value}", f'"api_key": "{value}"', f"token: {value} AKIA{value[:16].upper()}"])
        out.append((i, text))
    return out


def test_training_does_not_depend_on_order(spark):
    rows = secret_corpus() + [(-1, "token=0123456789abcdef0123456789abcdef0123456789abcdef"), (-2, None), (-3, "")]
    one = secrets.train(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    two = secrets.train(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5))
    assert (one.ratio == two.ratio).all() and one.threshold == two.threshold
    # a value that two patterns match is one labelled value
    assert secrets.samples(rows[-3][1])[1] == ["0123456789abcdef0123456789abcdef0123456789abcdef"]


def test_markov_spans_against_brute_force(spark):
    """Secrets that no fixed pattern matches are found, identifiers aren't; every span is what a plain reckoning gives."""
    rng = random.Random(22)
    rows = secret_corpus()
    planted = {}
    for i in range(0, 400, 2):
        value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.choice([20, 32, 40])))
        rows[i] = (i, rows[i][1] + f"sent {value} there")
        planted[i] = value
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = secrets.train(docs)
    assert models.threshold != secrets.THRESHOLD
    index = {c: k for k, c in enumerate(secrets._ALPHABET)}

    def reckoned(text):
        found = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
            if any(a < m.end() and m.start() < b for _, a, b in brute(text)):
                continue
            codes = [secrets.EDGE, *(index[c] for c in m[0]), secrets.EDGE]
            if any(c.isalpha() for c in m[0]) and max(sum(ratio[a, b] for a, b in zip(codes, codes[1:])) for ratio in models.ratio) > models.threshold * (len(codes) - 1):
                found.append(("markov", *m.span()))
        return found

    hits = 0
    for r in secrets.scan(docs, models).collect():
        text = rows[r.doc_id][1]
        spans = [tuple(s) for s in r.spans]
        assert [s for s in spans if s[0] != "markov"] == brute(text)
        own = [s for s in spans if s[0] == "markov"]
        assert own == reckoned(text) or any(a < y and x < b for _, a, b in own for _, x, y in brute(text))
        hits += r.doc_id in planted and planted[r.doc_id] in [text[a:b] for _, a, b in own]
        assert not any("get_user" in text[a:b] or "Integer" in text[a:b] or "tokens" in text[a:b] for _, a, b in own)
    assert hits >= 0.97 * len(planted)


def test_kinds_that_no_label_shows_are_found(spark):
    """Where only hexadecimal secrets are labelled, others are still told from identifiers."""
    rng = random.Random(23)
    rows = [(i, cases.prose(rng, 30) + ' token = "' + "".join(rng.choice(string.hexdigits[:16]) for _ in range(40)) + '"') for i in range(400)]
    models = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    for alphabet in (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.hexdigits[:16]):
        runs = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(60)]
        assert sum(models.score(r) > models.threshold for r in runs) >= 57
    for r in ("getUserNameById2FromTable", "max_tokens_per_batch_v2", "com/example/project1/module2"):
        assert models.score(r) < models.threshold


def test_redaction_of_a_column_in_capitals(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1234")], "doc_id long, Text string")
    assert secrets.redacted(docs, secrets.train(docs, threshold=1.5)).collect()[0].Text == "[SECRET]"
