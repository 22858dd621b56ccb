"""License scans: normalised sentences become identifiers, and identifier sequences match ordered licence rules.

A text is cut into pieces at line breaks and after . ! ? : or ; before white space. The normal form of a piece is lower-case,
with every run of other characters than ASCII letters and digits as one space, so comment marks go; dnl and rem at the
head of a line go too. One piece or several that follow each other without an empty line between (one of marks alone
is empty) are a known sentence if their joined normal form is; the longest from each piece on wins. So lines may be
wrapped anywhere, and a line of its own needs no full stop. Other sentences end after . ! ? : ; or at an empty line. A rule is a sequence of sentence identifiers; it matches
known sentences that follow each other in its order with at most ``GAP`` other sentences between two. From left to
right, the rule that covers most sentences wins, then the earlier in the list; matches do not overlap.

Defined cases: a null or empty text has no sentences and no licence; a sentence known twice is two sentences; repeated
rows are judged alike; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .io import map_batches, table

GAP = 2

#: Known licence sentences, in normal form, by identifier.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-4-notice": "licensed under cc by nc 4 0",
    "cc-by-4-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-notice": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-named": "the names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "boost-notice": "distributed under the boost software license version 1 0",
    "gpl2-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl3-library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "cc-by-sa-4-notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-full": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
}

#: Licences and the ordered sentences of their rules.
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache-notice-the", "apache-compliance", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-notice-the", "apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-notice", "apache-compliance")),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-notice-the",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0", ("gpl-program", "gpl-hope")),
    ("GPL-3.0", ("gpl-program",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-2.0", ("gpl2-program", "gpl-hope")),
    ("GPL-2.0", ("gpl2-program",)),
    ("GPL-2.0", ("gpl2-only",)),
    ("LGPL-3.0", ("lgpl3-library", "lgpl-hope")),
    ("LGPL-3.0", ("lgpl3-library",)),
    ("LGPL-2.1", ("lgpl21-library", "lgpl-hope")),
    ("LGPL-2.1", ("lgpl21-library",)),
    ("AGPL-3.0", ("agpl3-program", "gpl-hope")),
    ("AGPL-3.0", ("agpl3-program",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-full",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-named")),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("Unlicense", ("unlicense-notice", "unlicense-anyone")),
    ("Unlicense", ("unlicense-notice",)),
)

_KNOWN = {text.encode(): name for name, text in SENTENCES.items()}
#: Every known sentence holds one of these, so a text without them has none.
ANCHORS = (b"licen", b"permission", b"software", b"copyright", b"redistribut", b"warrant", b"distributed", b"contributors")
#: The normal forms of the first words of known sentences, whole ones too.
_HEADS = {b" ".join(w[: k + 1]) for w in (t.split(b" ") for t in _KNOWN) for k in range(len(w))}
_CUT = re.compile(rb"(?<=[.!?:;])[\x20\t\x0b\x0c]+|[\x20\t\x0b\x0c]*(?:\r\n|\n|\r)")
_GLUE = re.compile(rb"[^a-z0-9]+")
_MARK = re.compile(rb"(?:dnl|rem) ")


def pieces(raw: bytes) -> Iterator[tuple[int, int, bytes, bool, bool]]:
    """Byte ranges of the pieces with letters or digits and their normal forms, whether an empty line comes before, and
    whether a sentence begins there."""
    at, fresh, empty, begins = 0, True, False, True
    for m in [*_CUT.finditer(raw), None]:
        end = m.start() if m else len(raw)
        normal = _GLUE.sub(b" ", raw[at:end]).strip()
        if fresh and _MARK.match(normal + b" "):
            normal = normal[4:]
        line = m is None or raw[m.end() - 1] in b"\r\n"
        if normal:
            yield at, end, normal, empty, begins or empty
            empty, begins = False, raw[end - 1] in b".!?:;"
        elif fresh and line:
            empty = True
        at, fresh = m.end() if m else end, line


def known_sentences(raw: bytes) -> list[tuple[int, str, int, int]]:
    """Number, identifier and byte range of the known sentences; a known one counts as one sentence."""
    every, out, number, k, after = list(pieces(raw)), [], -1, 0, True
    while k < len(every):
        text, j, best = every[k][2], k, None
        while text in _HEADS:
            if text in _KNOWN:
                best = (_KNOWN[text], j)
            j += 1
            if j == len(every) or every[j][3]:
                break
            text += b" " + every[j][2]
        number += 1 if best or after or every[k][4] else 0
        if best:
            out.append((number, best[0], every[k][0], every[best[1]][1]))
        k, after = best[1] + 1 if best else k + 1, best is not None
    return out


def match_rules(known: list[tuple[int, str]], rules=RULES, gap: int = GAP) -> list[tuple[str, int, int]]:
    """Licence, first and last entry of ``known``, which holds sentence numbers and identifiers in order."""
    out, k = [], 0
    while k < len(known):
        best = None
        for licence, ids in rules:
            end = k + len(ids)
            if tuple(x[1] for x in known[k:end]) == ids and all(known[i + 1][0] - known[i][0] <= gap + 1 for i in range(k, end - 1)):
                if best is None or len(ids) > best[1] - k:
                    best = (licence, end)
        if best:
            out.append((best[0], k, best[1] - 1))
        k = best[1] if best else k + 1
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, known sentences, distinct licences and matches (licence:start:end in code points); no shuffle."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, buf, offs in tk.chunks(batch.column(1)):
            raw, low = buf.tobytes(), tk.lower(buf).tobytes()
            known_n, licences, spans = np.zeros(j - i, np.int64), [""] * (j - i), [""] * (j - i)
            for d in range(j - i):
                a, b = int(offs[d]), int(offs[d + 1])
                own = low[a:b]
                if not any(x in own for x in ANCHORS):
                    continue
                known = known_sentences(own)
                found = match_rules([x[:2] for x in known])
                known_n[d] = len(known)
                licences[d] = ",".join(sorted({x[0] for x in found}))
                point = lambda k: len(raw[a : a + k].decode())
                spans[d] = ",".join(f"{n}:{point(known[s][2])}:{point(known[e][3])}" for n, s, e in found)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(known_n), pa.array(licences), pa.array(spans)], ["doc_id", "n_known", "licences", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n_known long, licences string, spans string")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
