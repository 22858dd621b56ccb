"""Licence rules on texts as they are usually written: wrapped, in comments, and with marks inside sentences."""

import textwrap

import pytest

from tessera.llm import licenses

GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0'


def _wrapped(text, width, mark, end):
    lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
    return "Some words before it\n\n" + end.join(f"{mark}{x}".rstrip() for x in lines)


def _matches(text):
    known = licenses.known_sentences(text.lower().encode())
    return [(name, [x[1] for x in known[a : b + 1]]) for name, a, b in licenses.match_rules([x[:2] for x in known])]


@pytest.mark.parametrize("width", [34, 70, 79])
@pytest.mark.parametrize("mark, end", [("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", "\n"), ("dnl ", "\n"), ("REM ", "\r")])
def test_every_rule_with_wrapped_text(width, mark, end):
    for licence, ids in licenses.RULES:
        text = "\n\n".join(licenses.SENTENCES[x].capitalize() + "." for x in ids)
        assert _matches(_wrapped(text, width, mark, end)) == [(licence, list(ids))]
    for text, licence, n in ((GPL, "GPL-3.0", 2), (MPL, "MPL-2.0", 1), (APACHE, "Apache-2.0", 3)):
        got = _matches(_wrapped(text, width, mark, end))
        assert [(name, len(ids)) for name, ids in got] == [(licence, n)]


def test_lines_of_their_own_and_spans(spark):
    text = "Über uns\nReleased under\n the MIT License\nmore words"
    got = licenses.scan(spark.createDataFrame([(1, text), (2, "Released under the\n\nMIT License")], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licences, r.spans) for r in got} == {1: ("MIT", "MIT:9:40"), 2: ("", "")}
    # wrapped lines of one other sentence are one, so the gap is in sentences
    words = ". ".join("some\nwords over\nlines" for _ in range(2))
    text = f"{licenses.SENTENCES['apache-notice']}.\n{words}.\n{licenses.SENTENCES['apache-compliance']}."
    assert [len(ids) for _, ids in _matches(text)] == [2]
