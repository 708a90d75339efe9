"""Operator 10 against a plain matcher: every document against every item, word by word, without hashes or joins."""

import math
import random

import regex

from grainwise.llm import decontaminate as d

W = d.WINDOW


def words(text, name, initial, number, unit):
    text = text.replace("@", " ")
    text = regex.sub(d._NAME, name, text)
    text = regex.sub(d._INITIAL, initial, text)
    text = regex.sub(d._MEASURE, lambda m: f"{number(m)} {unit(m)} ", text)
    text = regex.sub(d._NUMBER, lambda m: f"{number(m)} ", text)
    return [w for w in regex.split(d._SPLIT, text.lower()) if w]


def marked(text):
    return words(text, "@p", lambda m: "@i" + m[0], lambda m: "@n", lambda m: "@u")


def annotated(text):
    number = lambda m: f"@n{m[1]}x{m[2] or ''}x{m[3] or ''}"
    return words(text, lambda m: "@p" + m[0], lambda m: "@i" + m[0], number, lambda m: "@u" + m[4])


def plain(ws):
    return [w[2:] if w.startswith("@i") else w for w in ws]


def typed(ws):
    return ["@p" if w.startswith("@i") else w for w in ws]


def literal(ws):
    return sum(not w.startswith("@") for w in ws)


def cuts(ws, size=W):
    return [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)]


def plain_words(text):
    parts = regex.split(rf"(?V1){d._EDGE}[\s\p{{Z}}]+{d._EDGE}", f" {text.lower()} ")
    return [w for w in parts if w]


def value(word):
    if word.startswith("@i"):
        return "@p" + word[2:]
    return word if word.startswith("@") else "@p" + word


def least(indexed):
    return max(math.ceil(indexed * d.MIN_SHARE), min(indexed, d.MIN_WINDOWS))


def covered(found):
    return {p + k for p in found for k in range(W)}


def run_starts(places):
    return [p for p in places if all(p + k in places for k in range(d.RUN_WORDS))]


def slots(item, doc, shift, places):
    return {(value(item[i]), value(doc[i + shift])) for i in places if item[i].startswith("@")}


def sound(pairs):
    return len({a for a, _ in pairs}) == len(pairs)


def by_template(text, item):
    m = marked(item)
    inside = plain(marked("a " + item.lstrip(" ")))[1 : W + 1]
    forms = {}
    for i, (a, b) in enumerate(zip(cuts(plain(m)), cuts(typed(m)))):
        if literal(a) >= d.MIN_LITERAL:
            forms[i] = {a} | ({b} if literal(b) >= d.MIN_LITERAL else set()) | ({tuple(inside)} if i == 0 else set())
    offsets = {}
    for pos, (a, b) in enumerate(zip(cuts(plain(marked(text))), cuts(typed(marked(text))))):
        for i, of in forms.items():
            if a in of or b in of:
                offsets.setdefault(pos - i, set()).add(i)
    enough, iw, dw = least(len(forms)), annotated(item), annotated(text)
    if not offsets:
        return False
    pairs = {s: slots(iw, dw, s, covered(f)) for s, f in offsets.items()}
    for s, found in offsets.items():
        places = covered(found)
        if any(sound(slots(iw, dw, s, range(p, p + d.RUN_WORDS))) for p in run_starts(places)):
            return True
        if sound(pairs[s]):
            together = set().union(*(f for t, f in offsets.items() if sound(pairs[t]) and sound(pairs[s] | pairs[t])))
            if len(together) >= enough:
                return True
    return False


def verbatim(text, item):
    m, p = plain(marked(item)), plain_words(item)
    if not p or not (len(m) < W or any(literal(w) < d.MIN_LITERAL for w in cuts(m))):
        return False
    if len(p) == 1:
        return any(plain_words(line) == p for line in regex.split(r"\r\n|\r|\n", text))
    size = min(len(p), W)
    mine, offsets = cuts(p, size), {}
    for pos, w in enumerate(cuts(plain_words(text), size)):
        for i, of in enumerate(mine):
            if w == of:
                offsets.setdefault(pos - i, set()).add(i)
    matched = set().union(*offsets.values()) if offsets else set()
    return bool(matched) and (len(matched) >= least(len(mine)) or any(run_starts(covered(f)) for f in offsets.values()))


NAMES = ["Tom", "Ann", "Bob", "Eve", "Zoë"]
NOUNS = ["apples", "pears", "km", "kg", "miles", "coins"]
FILLER = "the a of in basket house sells keeps how many are left after then every day while his her shop near river with".split()


def sentence(r):
    out = []
    for _ in range(r.randint(1, 22)):
        out.append(r.choice([r.choice(FILLER)] * 6 + [r.choice(NAMES), str(r.randint(2, 9)), r.choice(["two", "3.5", "12:30"]), f"{r.randint(2, 9)} {r.choice(NOUNS)}"]))
    text = " ".join(out) + r.choice([".", "?", "", ", she said."])
    return text[0].upper() + text[1:] if r.random() < 0.7 else text


def changed(r, text):
    """A copy of an item: as it is, with other values, with a word more or less, cut, or inside a sentence."""
    swap = dict(zip(NAMES, r.sample(NAMES, len(NAMES))))
    ws = text.split(" ")
    for kind in r.choices(["swap", "numbers", "mixed", "insert", "drop", "cut", "lower", "none"], k=2):
        if kind == "swap":
            ws = [swap.get(w, w) for w in ws]
        elif kind == "numbers":
            ws = [str(int(w) + 3) if w.isdecimal() else w for w in ws]
        elif kind == "mixed":
            ws = [r.choice(NAMES) if w in NAMES else str(r.randint(2, 9)) if w.isdecimal() else w for w in ws]
        elif kind == "insert":
            ws.insert(r.randrange(len(ws) + 1), r.choice(FILLER))
        elif kind == "drop" and len(ws) > 1:
            ws.pop(r.randrange(len(ws)))
        elif kind == "cut":
            ws = ws[r.randrange(len(ws)) :]
        elif kind == "lower":
            ws = [w[:1].lower() + w[1:] for w in ws]
    return " ".join(ws)


def test_equals_the_plain_matcher(spark):
    r = random.Random(11)
    items = list(dict.fromkeys([sentence(r) for _ in range(60)] + ["Yes", "2 + 2 = 4", "Tom, Ann, Bob", "", "the the the the the the"]))
    texts = ["", " ", "@p @n", "Yes\nno", "yes"]
    for _ in range(220):
        parts = [sentence(r)] + [changed(r, r.choice(items)) for _ in range(r.randint(0, 3))] + [sentence(r)]
        texts.append(r.choice([" ", "\n", ", "]).join(parts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in d.leaks(docs, bench).collect()}
    template = {(i, j) for i, t in enumerate(texts) for j, q in enumerate(items) if by_template(t, q)}
    exact = {(i, j) for i, t in enumerate(texts) for j, q in enumerate(items) if verbatim(t, q)}
    assert len(template) > 60 and len(exact - template) > 5
    assert got == template | exact
