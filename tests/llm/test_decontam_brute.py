"""Decontamination against a plain version that lays every item against every document in every place."""

import random

import pytest

from quadloom.llm import decontam

RUN, WINDOW, FEWEST = 13, 8, 5


def plain_words(text):
    """(plain form, possible template forms, may be a name or not, starts a sentence or line) of every word."""
    out = []
    for line in (text or "").splitlines():
        begin = True
        for raw in line.split():
            core = "".join(c for c in raw if c.isalnum())
            if core:
                low = core.lower()
                digits, letters = any(c.isdigit() for c in core), any(c.isalpha() for c in core)
                number = (digits and not letters) or low in decontam.NUMBER_WORDS
                previous = out[-1][4] if out else False
                if number:
                    forms = {"<number>"}
                elif digits and core[0].isdigit():
                    forms = {"<measure>"}
                elif low in decontam.UNITS and not digits:
                    forms = {"<unit>"} if previous else {low}
                elif not digits and len(core) > 1 and core[0].isupper() and core[1:].islower():
                    forms = {"<name>", low} if begin else {"<name>"}
                else:
                    forms = {low}
                out.append((low, forms, len(forms) > 1, begin, number))
                begin = False
            begin = begin or any(c in ".!?:" for c in raw[-3:])
    return out


def slot_of(d, i):
    """The slot in which two words may stand for each other, or none."""
    both = {f for f in d[1] & i[1] if f.startswith("<")}
    return min(both) if both else None


def consistent(pairs):
    there, back, loose = {}, {}, []
    for d, i in pairs:
        slots = [f for w in (d, i) if not w[2] for f in w[1] if f.startswith("<")]
        kind = slots[0] if slots else "<name>" if d[2] and i[2] else None
        if kind is None:
            continue
        if d[0] == i[0] and (d[2] or i[2] or d[1] != i[1]):
            loose.append((kind, i[0]))
        elif there.setdefault((kind, i[0]), d[0]) != d[0] or back.setdefault((kind, d[0]), i[0]) != i[0]:
            return False
    return all(there.get(x, x[1]) == x[1] and back.get(x, x[1]) == x[1] for x in loose)


def plain_longest(doc, item):
    """Words of the longest leaked run of an item in a document."""
    best, need, width = 0, min(RUN, len(item)), min(WINDOW, len(item))
    if len(item) < 2:
        return 0
    for shift in range(-len(item) + 1, len(doc)):
        if len(item) < FEWEST:
            own = doc[shift : shift + len(item)] if shift >= 0 else []
            end = shift + len(item)
            if [w[0] for w in own] == [w[0] for w in item] and own[0][3] and (end == len(doc) or doc[end][3]):
                best = max(best, len(item))
            continue
        places = [(d, d - shift) for d in range(max(0, shift), min(len(doc), shift + len(item)))]
        run = []
        for d, i in [*places, (None, None)]:
            if d is not None and (doc[d][0] == item[i][0] or slot_of(doc[d], item[i])):
                run.append((d, i))
                continue
            pairs = [(doc[a], item[b]) for a, b in run]
            run = []
            if len(pairs) < max(need, 1):
                continue
            seeds = any(all(x[0] == y[0] for x, y in pairs[k : k + width]) or all(x[1] & y[1] for x, y in pairs[k : k + width]) for k in range(len(pairs) - width + 1))
            leak = False
            for k in range(len(pairs) - need + 1):
                part = pairs[k : k + need]
                filled = sum(1 for x, y in part if slot_of(x, y) and not (x[0] == y[0] and (x[2] or y[2])))
                leak = leak or all(x[0] == y[0] for x, y in part) or (2 * filled <= need and consistent(part))
            if seeds and leak:
                best = max(best, len(pairs))
    return best


def sentence(rng, n):
    words = [rng.choice("the cat sat on a mat and ran for home by sea when march may".split()) if rng.random() < 0.7 else rng.choice(["Alice", "Bob", "Carol", "12", "7", "five", "km", "3", "5kg", "May", "March", "x2", "--"]) for _ in range(n)]
    return " ".join(words) + rng.choice([".", "!", "", "\n", ":"])


def mutated(rng, text):
    swap = {"Alice": "Dora", "Bob": "Erik", "12": "40", "7": "9", "5kg": "8kg"}
    out = [swap.get(w, w) if rng.random() < 0.8 else w for w in text.split(" ")]
    if rng.random() < 0.4:
        out[rng.randrange(len(out))] = "changed"
    return " ".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_every_alignment(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(sentence(rng, rng.randrange(1, 9)) for _ in range(rng.randrange(1, 5)))) for i in range(40)] + [(7, sentence(rng, 15))]
    docs = [None, "", " \n"]
    for _ in range(150):
        parts = [sentence(rng, rng.randrange(1, 20))]
        for _ in range(rng.randrange(0, 3)):
            text = rng.choice(items)[1]
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([text, mutated(rng, text), text.upper()]))
        docs.append(rng.choice([" ", "\n"]).join(parts))
    matcher, canonical = decontam.Matcher(items, decontam.Settings()), decontam.Canonical(bound=20)
    own = [(i, plain_words(t)) for i, t in items]
    found = 0
    for text in docs:
        doc, want = plain_words(text), {}
        for i, item in own:
            n = plain_longest(doc, item)
            if n:
                want[i] = max(n, want.get(i, 0))
        assert matcher.find(canonical, text) == want, text
        found += len(want)
    assert found > 100


def test_empty_tables_long_texts_and_clashing_columns(spark):
    item = "A painter mixes four red pots with nine blue pots and fills twelve jars to the brim."
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item)], "item_id long, text string")
    rows = [(1, "filler " * 120_000 + item), (2, None), (3, ""), (None, item), (1, "clean")]
    docs = spark.createDataFrame([(i, t, 1, [2], True) for i, t in rows], "doc_id long, text string, longest int, item_ids array<int>, m boolean")
    got = sorted(((r.doc_id, r.contaminated, list(r.item_ids), r.longest) for r in decontam.decontaminate(docs, bench).collect()), key=repr)
    assert got == sorted([(1, True, [1], 17), (2, False, [], 0), (3, False, [], 0), (None, True, [1], 17), (1, False, [], 0)], key=repr)
    assert decontam.decontaminate(docs.where("false"), bench).count() == 0
    small = decontam.Settings(characters=10)
    assert decontam.decontaminate(docs, bench, small).where("contaminated").count() == 2
