"""Licence recognition against a plain matcher that tries every run of pieces and every rule."""

import random
import re

from tessera.llm import licenses

WORD = re.compile(r"[a-z0-9]+")


def _plain(text):
    """Licences of a text by the rules as the docstring states them, piece by piece."""
    pieces, empty, begins, fresh, at = [], True, True, True, 0
    for m in [*re.finditer(r"(?<=[.!?:;])[ \t\x0b\x0c]+|[ \t\x0b\x0c]*(?:\r\n|\n|\r)", text), None]:
        own = text[at : m.start() if m else len(text)]
        words = WORD.findall(own.lower())
        if fresh and words[:1] in (["dnl"], ["rem"]):
            words = words[1:]
        line = m is None or m.group()[-1] in "\r\n"
        if words:
            pieces.append((words, empty, begins or empty))
            empty, begins = False, own[-1] in ".!?:;"
        elif fresh and line:
            empty = True
        at, fresh = (m.end() if m else 0), line
    known, number, k, after = [], -1, 0, True
    names = {tuple(t.split()): n for n, t in licenses.SENTENCES.items()}
    while k < len(pieces):
        best = None
        for j in range(k, len(pieces)):
            if j > k and pieces[j][1]:
                break
            found = names.get(tuple(w for p in pieces[k : j + 1] for w in p[0]))
            best = (j, found) if found else best
        if best or after or pieces[k][2]:
            number += 1
        if best:
            known.append((number, best[1]))
        k, after = (best[0] if best else k) + 1, bool(best)
    out, k = [], 0
    while k < len(known):
        fits = []
        for place, (licence, ids) in enumerate(licenses.RULES):
            own = known[k : k + len(ids)]
            if [x[1] for x in own] == list(ids) and all(b[0] - a[0] <= licenses.GAP + 1 for a, b in zip(own, own[1:])):
                fits.append((-len(ids), place, licence))
        out += [min(fits)[2]] if fits else []
        k += -min(fits)[0] if fits else 1
    return len(known), ",".join(sorted(set(out)))


def test_random_texts_match_a_plain_matcher(spark):
    rng = random.Random(12)
    texts = [None, "", " \n\n", "licence", "The software is provided"]
    other = ["See the manual.", "Copyright (c) 2020 A. Person", "x: y; z!", "dnl", "", "warranty"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 7)):
            text = rng.choice([rng.choice(list(licenses.SENTENCES.values())), *rng.sample(other, 1)])
            words = text.split(" ")
            if rng.random() < 0.1 and len(words) > 3:
                del words[rng.randrange(len(words))]
            lead = rng.choice(["", "# ", " * ", "// "])
            body, line = [], lead
            for w in words:
                line += rng.choice([w, w, w.upper(), w + ","]) + " "
                if rng.random() < 0.12:
                    body.append(line.rstrip())
                    line = lead
            parts.append("\n".join([*body, line.rstrip()]) + rng.choice([".", ".", ";", "", ""]))
        texts.append(rng.choice([" ", "\n", "\n\n", "\r\n"]).join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_known, r.licences) for r in licenses.scan(docs).collect()}
    want = {k: _plain(t or "") for k, t in enumerate(texts)}
    assert got == want and sum(bool(x[1]) for x in want.values()) > 150


def test_every_rule_is_found_in_wrapped_text(spark):
    texts = []
    for _, ids in licenses.RULES:
        words, lines = " ".join(licenses.SENTENCES[i] + "." for i in ids).split(" "), [""]
        for w in words:
            if len(lines[-1]) + len(w) > 70:
                lines.append("")
            lines[-1] += w + " "
        texts.append("\n".join(" * " + x.rstrip() for x in lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(docs).collect()}
    assert got == {k: name for k, (name, _) in enumerate(licenses.RULES)}
