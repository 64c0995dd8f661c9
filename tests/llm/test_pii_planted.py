"""Disguised identifiers planted in documents of the corpus's four languages, and the time of mixed texts."""

import random
import time

import pytest

from sourcelens.llm import common, pii

DIGITS = {
    "en": "zero one two three four five six seven eight nine", "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
AT = {"en": "at", "fr": "arobase", "de": "ät", "es": "arroba"}
DOT = {"en": "dot", "fr": "point", "de": "punkt", "es": "punto"}
PLUS = {"en": "plus", "fr": "plus", "de": "plus", "es": "más"}
NAMES = ["anna", "ivo42", "m_lee", "t.karr", "zoe"]
HOSTS = ["mailbox.example", "post.example", "firma.example"]
ENDINGS = ["com", "nl", "de", "fr", "es", "app", "info"]


def luhn_number(rng):
    body = "".join(rng.choices("0123456789", k=15))
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


def planted(rng, lang):
    """(kind, text) of one identifier in each disguise."""
    say = dict(zip("0123456789", DIGITS[lang].split()))
    spelled = lambda digits: " ".join(say[c] for c in digits)
    name, host, end = rng.choice(NAMES), rng.choice(HOSTS), rng.choice(ENDINGS)
    plain = f"{name}@{host}.{end}"
    yield "email", f"{name} {AT[lang]} {host.replace('.', f' {DOT[lang]} ')} {DOT[lang]} {end}"
    yield "email", f"{name} ({AT[lang]}) {host} [{DOT[lang]}] {end}"
    yield "email", f"{name}(at){host}(dot){end}"
    yield "email", plain.replace("a", "а").replace("o", "о")  # Cyrillic
    yield "email", plain[:2] + "​" + plain[2:]
    digits = "".join(rng.choices("0123456789", k=11))
    yield "phone", f"{PLUS[lang]} {spelled(digits)}"
    yield "phone", "＋" + digits.translate({48 + i: 0xFF10 + i for i in range(10)})
    yield "card", spelled(luhn_number(rng))
    yield "card", luhn_number(rng).translate({48 + i: 0x0660 + i for i in range(10)})
    yield "ip", f" {DOT[lang]} ".join(spelled(str(rng.randrange(10))) for _ in range(4))


def test_planted_recall(spark, data):
    rng, hit, all_, extra = random.Random(11), {}, {}, 0
    rows = [r for r in common.table(spark, data, "documents").orderBy("doc_id").collect() if r["text"] and r["lang"] in DIGITS]
    for r in rows:
        extra += len(pii.spans(r["text"])[1]) - len(pii.spans(r["text"])[0])
        lines = r["text"].split("\n")
        for kind, what in planted(rng, r["lang"]):
            k = rng.randrange(len(lines) + 1)
            before = "".join(x + "\n" for x in lines[:k])
            text = before + what + "\n" + "\n".join(lines[k:])
            found = pii.spans(text)[1]
            all_[r["lang"], kind] = all_.get((r["lang"], kind), 0) + 1
            hit[r["lang"], kind] = hit.get((r["lang"], kind), 0) + ((kind, len(before), len(before) + len(what)) in found)
    recall = {k: hit[k] / n for k, n in all_.items()}
    print(sum(hit.values()), sum(all_.values()), extra, recall)
    assert {lang for lang, _ in recall} == set(DIGITS) and min(recall.values()) > 0.95
    assert extra == 0


MIXED = ["a@b.cc xx(at)yy(dot)zz ", "a@b.cc one two three four ", "j arroba b punto es 10.0.0.1 ", "+1 555 123 4567 one at b dot com ", "а@b.cc 4111 1111 1111 1111 plus un deux "]


@pytest.mark.parametrize("text", MIXED)
def test_mixed_texts_are_linear(text):
    def took(n):
        began = time.perf_counter()
        found = pii.spans(text * n)
        assert len(found[1]) >= n / 2
        return time.perf_counter() - began

    took(100)
    small, large = min(took(2000) for _ in range(3)), took(16_000)
    assert large < 5 and large < 24 * max(small, 0.02)
