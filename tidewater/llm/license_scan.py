"""License scan by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, every run of other characters than
letters and digits becomes one space) and looked up among known license sentences.  The identifiers found,
in text order, are matched against ordered rules: a rule fits where its identifiers stand next to each
other among the known sentences, with at most ``max_gap`` unknown sentences between two of them.  Rules
are tried in order and a sentence serves one rule only, so a fuller license text wins over its parts.

A text is cut after . ! ? or : before white space and at every end of line, and a known sentence may run over any
number of such parts, empty lines and lines of comment marks among them; where several known sentences start at one part, the
longest is taken.  Unknown parts of one line and sentence count as one unknown sentence.  Texts without any anchor word of a
known sentence cannot match and are passed over.

Defined results: null or empty text has no sentences and no license; a repeated row gives a repeated
result; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import as_bytes, id_text, pieces

# Sentences of public license texts and notices.
SENTENCES = {
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0.",
    "ccby4-notice": "Licensed under CC BY 4.0.",
    "ccbysa4-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-long": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd2-notice": "Licensed under the BSD 2-Clause License.",
    "bsd3-notice": "Licensed under the BSD 3-Clause License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-notice": "Released under the ISC License.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "unlicense-domain": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-copy-secure": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-terms": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "cc0-notice": "This work is licensed under a Creative Commons CC0 1.0 Universal License.",
    "cc0-dedication": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law. You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
    "ccby4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbync4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccbynd4-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "ccbyncsa4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "ccbyncnd4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "ccbysa3-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "ccby3-long": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "artistic2-notice": "Licensed under the Artistic License 2.0.",
    "ofl-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "gfdl13-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    "apache2-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
}
# License, then the sentences that state it; fuller texts first.
RULES = [
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("Apache-2.0", ["apache2-long", "apache2-copy", "apache2-basis"]),
    ("Apache-2.0", ["apache2-long", "apache2-copy"]),
    ("Apache-2.0", ["apache2-long"]),
    ("MIT", ["mit-grant", "asis"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-1-Clause", ["bsd-redistribution", "bsd-source"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("LicenseRef-BSD", ["bsd-redistribution"]),  # the first words alone do not say which
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-notice"]),
    ("MIT-0", ["mit0-grant", "asis"]),
    ("MIT-0", ["mit0-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Unlicense", ["unlicense-domain"]),
    ("WTFPL", ["wtfpl-title"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-redistribute"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-notice", "mpl2-copy-secure"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("EPL-1.0", ["epl1-terms"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-long"]),
    ("CC-BY-NC-ND-4.0", ["ccbyncnd4-long"]),
    ("CC-BY-NC-4.0", ["ccbync4-long"]),
    ("CC-BY-ND-4.0", ["ccbynd4-long"]),
    ("CC-BY-4.0", ["ccby4-long"]),
    ("CC-BY-SA-3.0", ["ccbysa3-long"]),
    ("CC-BY-3.0", ["ccby3-long"]),
    ("Artistic-2.0", ["artistic2-notice"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("GFDL-1.3-or-later", ["gfdl13-grant"]),
]
ANCHORS = re.compile(rb"licen[sc]e|granted|warrant|distribut|eclipse|endorse", re.I)
END = re.compile(r"(?<=[.!?])\s+|\n")
COLON = re.compile(r"(?<=:)\s+")
OTHER = re.compile(r"[\W_]+")


def normalise(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower()).strip()


def beginnings(known: dict[str, str]) -> set[str]:
    """Every known sentence, up to the end of each of its words."""
    return {key[: m.end()] for key in known for m in re.finditer(r"\w+", key)}


def recognise(text: str, known: dict[str, str], begun: set[str]) -> list[str | None]:
    """Sentence identifiers in order; None for an unknown sentence."""
    parts = [(n, key) for n, unit in enumerate(END.split(text)) for key in map(normalise, COLON.split(unit)) if key]
    out, i, unknown = [], 0, None
    while i < len(parts):
        n, joined = parts[i]
        j, found, end = i + 1, None, i + 1
        while joined in begun:
            if joined in known:
                found, end = known[joined], j
            if j == len(parts):
                break
            joined += " " + parts[j][1]
            j += 1
        if found or n != unknown:
            out.append(found)
        i, unknown = end, None if found else n
    return out


def apply_rules(ids: list[str | None], rules: list[tuple[str, list[str]]], max_gap: int) -> list[str]:
    """Licenses in text order."""
    places = [i for i, x in enumerate(ids) if x]
    used, found = set(), []
    for name, wanted in rules:
        k = len(wanted)
        for j in range(len(places) - k + 1):
            run = places[j : j + k]
            if not used & set(run) and [ids[p] for p in run] == wanted and all(b - a - 1 <= max_gap for a, b in zip(run, run[1:])):
                used |= set(run)
                found.append((run[0], name))
    return [name for _, name in sorted(found)]


def scan(df: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES, max_gap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, sentence_ids and licenses (arrays of strings, in text order), n_sentences known, license (the first or null)."""
    known = {normalise(s): k for k, s in sentences.items()}
    begun = beginnings(known)
    for s in sentences.values():
        if not ANCHORS.search(s.encode()):
            raise ValueError(f"no anchor word in the known sentence {s!r}")

    def run(batches):
        for batch in pieces(batches):
            ids = [[]] * batch.num_rows
            licenses = [[]] * batch.num_rows
            for i, text in enumerate(as_bytes(batch.column("text"))):
                if ANCHORS.search(text):
                    found = recognise(text.decode(), known, begun)
                    licenses[i] = apply_rules(found, rules, max_gap)
                    ids[i] = [x for x in found if x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.string())), pa.array(licenses, pa.list_(pa.string())), pa.array(list(map(len, ids)), pa.int64()), pa.array([x[0] if x else None for x in licenses], pa.string())],
                ["doc_id", "sentence_ids", "licenses", "n_sentences", "license"],
            )

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sentence_ids array<string>, licenses array<string>, n_sentences bigint, license string")
