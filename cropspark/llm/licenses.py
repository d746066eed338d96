"""Licence scan by sentence rules.

A text is cut into sentences, each sentence is normalised, and known licence sentences get an identifier. The identifiers of a
document in order, with a break where more than MAX_GAP unknown sentences lie between two of them, are matched against ordered
licence rules: the longest rule at the first position wins, and its sentences are used up. Known sentences that complete no rule
are no match.

Null and empty texts have no match. Offsets are code points of the whole text, from the first sentence's start to the last
one's end. Repeated rows give repeated results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

MAX_GAP = 2

# Sentences of public licence texts and notices, as `normalise` leaves them, by identifier.
SENTENCES = {
    "apache-notice": ["licensed under the apache license version 2.0", "released under the apache license version 2.0", "this work is licensed under the apache license version 2.0"],
    "apache-header": ["licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license-2.0", "you may obtain a copy of the license at https www apache org licenses license-2.0"],
    "apache-warranty": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-terms": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-warranty": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorsement": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd2-notice": ["released under the bsd 2-clause license", "licensed under the bsd 2-clause license"],
    "bsd3-notice": ["released under the bsd 3-clause license", "licensed under the bsd 3-clause license"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "gpl3-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-details": ["see the gnu general public license for more details"],
    "lgpl3-notice": ["licensed under the gnu lesser general public license version 3"],
    "mpl2-header": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0"],
    "cc-by-notice": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-notice": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc-notice": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-nd-notice": ["licensed under cc by-nd 4.0"],
    "cc0-notice": ["licensed under cc0 1.0", "released under cc0 1.0"],
    "unlicense-grant": ["this is free and unencumbered software released into the public domain"],
    "unlicense-rights": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means"],
}

# Licence identifiers and the sentences that state them, in order.
RULES = [
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-warranty", "apache-terms"]),
    ("Apache-2.0", ["apache-header", "apache-warranty", "apache-terms"]),
    ("Apache-2.0", ["apache-header"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("LGPL-3.0-only", ["lgpl3-notice"]),
    ("MPL-2.0", ["mpl2-header", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-header"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense-grant", "unlicense-rights"]),
    ("Unlicense", ["unlicense-grant"]),
]

_IDENTIFIER = {sentence: name for name, forms in SENTENCES.items() for sentence in forms}
_FIRST_WORDS = {s.split()[0] for s in _IDENTIFIER}
_LONGEST_FIRST = sorted(RULES, key=lambda r: -len(r[1]))
_PIECE = re.compile(r"[^\n.!?;:]+(?:[.!?;:]+(?=\S)[^\n.!?;:]+)*")
_WORD = re.compile(r"[A-Za-z0-9]+")


def normalise(sentence: str) -> str:
    """Lower case; letters, digits and inner points and hyphens stay, all else becomes one space; licence is license."""
    kept = re.sub(r"[^a-z0-9.\-]+", " ", sentence.lower())
    kept = re.sub(r"(?<![a-z0-9])[.\-]+|[.\-]+(?![a-z0-9])|(?<=[a-z])\.(?=[a-z])", " ", kept)
    return " ".join(kept.replace("licence", "license").split())


def known_sentences(text: str) -> list[tuple[int, int, int, int, str]]:
    """(first piece, last piece, start, end, identifier) of the known sentences of a text.

    A piece ends at a line end or a sentence sign before white space; following pieces are joined while they continue a known
    sentence, so a sentence may be wrapped over lines. Pieces without a word do not count. The longest known sentence wins.
    """
    pieces = [p for p in _PIECE.finditer(text) if _WORD.search(p.group())]
    out, i = [], 0
    while i < len(pieces):
        first = _WORD.search(pieces[i].group())
        last, identifier = i, None
        if first and first.group().lower() in _FIRST_WORDS:
            joined = ""
            for j in range(i, len(pieces)):
                joined = f"{joined} {normalise(pieces[j].group())}".strip()
                if joined in _IDENTIFIER:
                    last, identifier = j, _IDENTIFIER[joined]
                if not any(s.startswith(joined + " ") for s in _IDENTIFIER):
                    break
        if identifier:
            start = pieces[i].start() + first.start()
            out.append((i, last, start, pieces[last].end(), identifier))
        i = last + 1
    return out


def match(text: str | None) -> list[tuple[str, int, int, int]]:
    """(licence, start, end, number of sentences) of each rule that the text states, in order."""
    known = known_sentences(text or "")
    out, i = [], 0
    while i < len(known):
        for licence, rule in _LONGEST_FIRST:
            part = known[i : i + len(rule)]
            near = all(b[0] - a[1] - 1 <= MAX_GAP for a, b in zip(part, part[1:], strict=False))
            if near and [k[4] for k in part] == rule:
                out.append((licence, part[0][2], part[-1][3], len(rule)))
                i += len(rule)
                break
        else:
            i += 1
    return out


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each match: id, license, start, end, sentences."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, *m) for n, body in enumerate(batch["body"]) for m in match(body)]
            found = pd.DataFrame(rows, columns=["n", "license", "start", "end", "sentences"])
            yield pd.DataFrame({"key": batch["key"].take(found["n"]).array}).assign(**{c: found[c] for c in ("license", "start", "end", "sentences")})

    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInPandas(run, f"key {kind}, license string, start bigint, end bigint, sentences bigint")
    return out.withColumnRenamed("key", id)
