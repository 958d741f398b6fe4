import random
import re

import pytest

from quadrille.llm import licenses

from . import cases


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(words), sorted(starts), sorted(labels)


def test_phrases_against_brute_force():
    rng = random.Random(6)
    parts = ["CC", "by", "General", "Public", "License", "all", "Rights", "reserved", "İ", "é", " ", "-", ".", " ", "\n", "x1"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert licenses.scan_text(t)[:3] == brute(t), t


def test_automata():
    a = licenses.Automaton("one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> <<var;x;1;2>> four <<var;y;a b|c>>")
    accept = lambda t: a.match(t.encode().split(), 0) == len(t.split())
    assert accept("one x four c") and accept("one two x y four a b") and accept("one two three x four c")
    assert not accept("one four c") and not accept("one x y z w four c") and not accept("one x four a") and not accept("one x fore c")


def test_templates():
    for name, markup in licenses.TEMPLATES.items():
        plain = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", markup, flags=re.S)
        plain = re.sub(r"<<var;\w+;(\d+);\d+>>", lambda m: " ".join(["acme"] * int(m[1])), plain)
        plain = re.sub(r"<<var;\w+;([^|>]+)[^>]*>>", r"\1", plain)
        text = f"Before, {plain.upper()}. After"
        assert name in {m[0] for m in licenses.scan_text(text)[3]}, name
        words = plain.split()
        broken = " ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 + 1 :])
        if name in ("mit", "bsd", "isc", "unlicense"):
            assert name not in {m[0] for m in licenses.scan_text(broken)[3]}


def test_scan(spark):
    got = {r.doc_id: r for r in licenses.scan(cases.table(spark)).collect()}
    for r in cases.rows()[:18]:
        assert (got[r[0]].n_words, got[r[0]].starts, got[r[0]].base_labels) == brute(r[1])
        assert 0 <= got[r[0]].score <= 1
    assert got[13].score > 0.9 > got[5].score == 0
    assert licenses.scan(cases.empty(spark)).count() == 0


def spelled(markup):
    """A text that the template accepts, without its optional regions, as (word, whether it is mandatory)."""
    out, depth = [], 0
    for token in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if token == "<<beginOptional>>":
            depth += 1
        elif token == "<<endOptional>>":
            depth -= 1
        elif depth:
            continue
        elif token.startswith("<<"):
            rest = token[2:-2].split(";")[2:]
            out += [(w, False) for w in (["someone"] * int(rest[0]) if len(rest) == 2 else rest[0].split("|")[0].split())]
        else:
            out.append((token, True))
    return out


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_every_mandatory_word_counts(name):
    words = spelled(licenses.TEMPLATES[name])
    plain = [w for w, _ in words]
    automaton = licenses.automata()[name]
    encode = lambda ws: [w.encode() for w in ws]
    assert automaton.match(encode(plain), 0) == len(plain)
    assert name in {m[0] for m in licenses.scan_text("see: " + ", ".join(plain) + ".")[3]}
    for i, (_, mandatory) in enumerate(words):
        if mandatory:
            assert automaton.match(encode([*plain[:i], *plain[i + 1 :]]), 0) < 0, plain[max(0, i - 3) : i + 3]
            assert automaton.match(encode([*plain[:i], "zebra", *plain[i + 1 :]]), 0) < 0, plain[max(0, i - 3) : i + 3]


def test_optional_regions_of_full_texts():
    bsd = " ".join(w for w, _ in spelled(licenses.TEMPLATES["bsd"]))
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE is provided by"
    for text in (bsd, bsd.replace("this software is provided by", third), bsd.replace("someone", "the copyright holder and contributors")):
        assert {m[0] for m in licenses.scan_text(text)[3]} == {"bsd"}
    gpl = " ".join(w for w, _ in spelled(licenses.TEMPLATES["gpl"])) + " see <https://www.gnu.org/licenses/>"
    assert max(m[2] for m in licenses.scan_text(gpl)[3] if m[0] == "gpl") == len(licenses.words_of(gpl))
