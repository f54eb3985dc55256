"""License scans by sentence rules.

A text is cut into sentences, which are normalised and mapped to identifiers of
known licence sentences; unknown sentences are left out of the sequence.  Ordered
rules then match runs of identifiers: a rule that matches names a licence and uses
its identifiers up, so that longer rules, which come first, win over their parts.
``SPDX-License-Identifier`` lines name their licences themselves.

A sentence begins and ends where the text does, at a blank line, at ``.!?:`` before white
space and at a line break that no lower-case word follows.  Inside a known sentence any line
break may be a wrapped line, comment marks and all; a blank line or a full stop may not,
except where the known sentence has one itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.textops import empty_text, slices

# Known licence sentences by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "This work is dedicated to the public domain under CC0 1.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-licensed": "Licensed under the BSD 3-Clause License.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND <holder> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-liable": "IN NO EVENT SHALL <holder> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "isc-title": "ISC License",
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License",
    "mit-title-twice": "The MIT License (MIT)",
    "mit-project": "This project is licensed under the MIT License.",
    "mit-software": "This software is licensed under the MIT License.",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache2-url": "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache2-title": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/",
    "apache2-title-short": "Apache License\nVersion 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache2-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "apache2-project": "This project is licensed under the Apache License 2.0.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse-holder": "Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-author": "The name of <holder> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY <holder> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liable": "IN NO EVENT SHALL <holder> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd3-title": "BSD 3-Clause License",
    "bsd2-title": "BSD 2-Clause License",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007",
    "fsf-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-later-library": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-copy-write": "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-copy-see": "You should have received a copy of the GNU General Public License along with this program; if not, see <http://www.gnu.org/licenses/>.",
    "gnu-url": "If not, see <http://www.gnu.org/licenses/>.",
    "lgpl-copy": "You should have received a copy of the GNU Lesser General Public License along with this program.",
    "lgpl-copy-write": "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0/",
}

# Rules in order; each names a licence for a run of identifiers.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is-software", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-software"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms", "apache2-grant"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms"]),
    ("Apache-2.0", ["apache2-title-short", "apache2-terms", "apache2-grant"]),
    ("Apache-2.0", ["apache2-title-short", "apache2-terms"]),
    ("Apache-2.0", ["apache2-header", "apache2-url", "apache2-as-is", "apache2-see"]),
    ("Apache-2.0", ["apache2-header", "apache2-copy", "apache2-as-is"]),
    ("Apache-2.0", ["apache2-header", "apache2-url", "apache2-as-is"]),
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse-holder"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-holder"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse-author"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-only", ["gpl3-title", "fsf-verbatim", "gpl3-later", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-title", "fsf-verbatim", "gpl2-later", "gpl-hope"]),
    ("LGPL-2.1-only", ["lgpl21-title", "fsf-verbatim", "lgpl21-later", "lgpl-hope"]),
    ("AGPL-3.0-only", ["agpl3-title", "fsf-verbatim", "agpl3-later", "gpl-hope"]),
    ("GPL-3.0-only", ["gpl3-title", "fsf-verbatim"]),
    ("GPL-2.0-only", ["gpl2-title", "fsf-verbatim"]),
    ("LGPL-3.0-only", ["lgpl3-title", "fsf-verbatim"]),
    ("LGPL-2.1-only", ["lgpl21-title", "fsf-verbatim"]),
    ("AGPL-3.0-only", ["agpl3-title", "fsf-verbatim"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope"]),
    ("GPL-3.0-only", ["gpl3-only", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-later-library", "lgpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-hope"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liable"]),
    ("ISC", ["isc-grant-and", "isc-as-is", "isc-liable"]),
    ("MPL-2.0", ["mpl2", "mpl2-copy"]),
    ("Zlib", ["zlib-as-is", "zlib-liable"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later-library"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("Apache-2.0", ["apache2-header"]),
    ("Apache-2.0", ["apache2-licensed"]),
    ("Apache-2.0", ["apache2-project"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-project"]),
    ("MIT", ["mit-software"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-title-the"]),
    ("MIT", ["mit-title-twice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-work"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC0-1.0", ["cc0"]),
    ("BSD-3-Clause", ["bsd-licensed"]),
    ("BSD-3-Clause", ["bsd3-title"]),
    ("BSD-2-Clause", ["bsd2-title"]),
    ("MPL-2.0", ["mpl2"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("ISC", ["isc-title"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost-grant"]),
    ("EPL-2.0", ["epl2"]),
]

# Licences that an SPDX line may name, and older names of some.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA OFL-1.1 OpenSSL OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib"
).split()
SPDX_OLD = {f"{x}{old}": f"{x}{new}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for old, new in (("", "-only"), ("+", "-or-later"))}
_SPDX = {k.lower(): v for k, v in {**{x: x for x in SPDX}, **SPDX_OLD}.items()}

#: Identifiers with this part are titles, before which the text must stop: a line break alone may be a wrapped sentence.
TITLE = "-title"
#: Words that a <holder> may have at most.
HOLDER_WORDS = 40

# What SQL and plain tests take as line breaks to join, and as ends of sentences.
_WRAP = r"\n[ \t]*(?:[#*;%]+|//+)?[ \t]*([a-z(])"
_END = r"[.!?:][.!?:*#$%&]*\s+|\n\s*"
# Ends of sentences inside known sentences, and what stands for them.
_INNER = [(r"(?i)free software:\s", "free software "), (r"(?i)License, v\.\s2", "License, v 2")]


def normalise(sentence: str) -> str:
    """Lower case, letters and digits only, single spaces between."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _known() -> dict[str, str]:
    """Normalised sentence -> identifier, for sentences without a holder's name and without inner paragraphs."""
    return {normalise(s): k for k, s in SENTENCES.items() if "<holder>" not in s and "\n\n" not in s}


_WORD = re.compile("[A-Za-z0-9]+")
_STOP = re.compile(r"[.!?:][^\w\s]*(?:\s|\Z)")
_TAG = ("spdx", "license", "identifier")
_HOLDER = "<"


def _words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words, and for each the place where it begins and where it ends."""
    met = list(_WORD.finditer(text))
    words = [m.group().lower() for m in met]
    return ["http" if w == "https" else w for w in words], [m.start() for m in met], [m.end() for m in met]


def _stops(gap: str) -> bool:
    """Whether what is between two words ends a sentence even inside a wrapped one."""
    return gap.count("\n") > 1 or bool(_STOP.search(gap))


def _patterns() -> dict[str, list[tuple[list[str], set[int], str]]]:
    """First word -> (words, places after which the sentence itself has a stop, identifier), longest first."""
    out: dict[str, list] = {}
    for name, s in SENTENCES.items():
        s = s.rstrip(".:")
        words, first, last = _words(s)
        words = [_HOLDER if w == "holder" and s[a - 1] == "<" else w for w, a in zip(words, first, strict=True)]
        stops = {i for i in range(len(words) - 1) if _stops(s[last[i] : first[i + 1]])}
        out.setdefault(words[0], []).append((words, stops, name))
    for same in out.values():
        same.sort(key=lambda x: -len(x[0]))
    return out


PATTERNS = _patterns()


def known_sentences(text: str) -> list[str]:
    """Identifiers of the known sentences of a text, in order."""
    words, first, last = _words(text)
    n = len(words)

    def gap(i: int) -> str:  # what is between words i and i + 1
        return text[last[i] if i >= 0 else 0 : first[i + 1] if i + 1 < n else len(text)]

    def edge(i: int) -> bool:  # whether a sentence may end after word i
        if i < 0 or i == n - 1:
            return True
        g = gap(i)
        return _stops(g) or ("\n" in g and not text[first[i + 1]].islower() and not g.endswith("("))

    def end_of(at: int, pattern: list[str], stops: set[int]) -> int | None:
        """The place after the sentence that begins at word ``at``, if it does."""
        for i, w in enumerate(pattern):
            if w == _HOLDER:
                rest, stops_in = pattern[i + 1 :], {s - i - 1 for s in stops}
                for k in range(at + 1, min(at + HOLDER_WORDS, n - len(rest)) + 1):
                    if gap(k - 2).count("\n") > 1 or gap(k - 1).count("\n") > 1:
                        return None  # a name holds no blank line
                    if words[k] == rest[0] and (end := end_of(k, rest, stops_in)) is not None:
                        return end
                return None
            if at >= n or words[at] != w or (i < len(pattern) - 1 and i not in stops and _stops(gap(at))):
                return None
            at += 1
        return at if edge(at - 1) else None

    out, at = [], 0
    while at < n:
        if tuple(words[at : at + 3]) == _TAG:
            line = text[last[at + 2] :].split("\n", 1)[0]
            out += [f"spdx:{_SPDX[x.lower()]}" for x in re.findall(r"[A-Za-z0-9.+-]*[A-Za-z0-9+]", line) if x.lower() in _SPDX]
            at += 3
            continue
        end = None
        if words[at] in PATTERNS and edge(at - 1):
            fresh = at == 0 or _stops(gap(at - 1))
            for pattern, stops, name in PATTERNS[words[at]]:
                if (fresh or TITLE not in name) and (end := end_of(at, pattern, stops)) is not None:
                    out.append(name)
                    break
        at = end or at + 1
    return out


def _cues() -> list[str]:
    """Words of seven letters or more of which every known sentence, and every SPDX line, holds one; the commonest first, then by name."""
    left, out = [set(re.findall("[a-z]{7,}", normalise(s))) for s in (*SENTENCES.values(), "SPDX-License-Identifier")], []
    while left:
        words = sorted({w for s in left for w in s})
        out.append(max(words, key=lambda w: sum(w in s for s in left)))
        left = [s for s in left if out[-1] not in s]
    return out


#: No known sentence lacks all of these words, so other texts need no splitting.
CUES = "(?i)" + "|".join(_cues())


def apply_rules(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Licences named by the rules, in rule order and each once; identifiers are used up by the first rule."""
    state = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit("|"))), "|"))
    start = F.struct(state.alias("left"), F.array().cast("array<string>").alias("found"))
    table = F.array(*[F.struct(F.lit("|" + "||".join(run) + "|").alias("run"), F.lit(name).alias("name")) for name, run in rules])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["run"])
        return F.struct(
            F.replace(acc["left"], rule["run"], F.lit("|#|")).alias("left"),
            F.when(hit, F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        )

    return F.array_distinct(F.aggregate(table, start, step)["found"])


def sentence_ids(docs: DataFrame) -> DataFrame:
    """doc_id and ids, the identifiers of the known sentences, of every whole text; texts without a cue are not looked through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = [known_sentences(t) if t else [] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "ids"])

    text = empty_text()
    cued = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(CUES), text).alias("text"))
    return cued.mapInArrow(run, "doc_id long, ids array<string>")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids and licenses (comma-joined) of every whole text.

    Licences come in the order of the rules, then those that SPDX lines name.  Null text is empty,
    which has none: 0 and empty strings; repeated rows give a row each; an empty table none; only
    doc_id and text are read.
    """
    tag = "spdx:"
    named = F.transform(F.filter("ids", lambda x: x.startswith(tag)), lambda x: F.substr(x, F.lit(len(tag) + 1)))
    found = F.when(F.size("ids") > 0, F.array_distinct(F.concat(apply_rules(F.col("ids")), named))).otherwise(F.array().cast("array<string>"))
    return sentence_ids(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(found, ",").alias("licenses"),
    )
