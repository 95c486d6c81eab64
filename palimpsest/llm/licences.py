"""Licence scan by canonical digests, in DataFrame operations only.

A text is brought to a canonical form (ASCII lower case, copyright lines dropped, punctuation and
white space as one space, equivalent spellings unified) and its SHA-256 is looked up among those of
known licence texts, by a hash join on whole texts.  The lines of the same canonical form are looked
up among known one-line notices, within the row.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that licence matching counts as equal, canonical form last.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("authorisation", "authorization"), ("recognise", "recognize"), ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("https", "http"),
)

_PERMISSIVE_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

# Whole licence texts by SPDX identifier, without their title.
TEXTS = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{_PERMISSIVE_END} IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "MIT-0": f"""Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so.

{_PERMISSIVE_END} IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD_TWO}\n{_BSD_END}",
    "BSD-3-Clause": f"""{_BSD_TWO}
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

{_BSD_END}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
   that you wrote the original software. If you use this software in a product,
   an acknowledgment in the product documentation would be appreciated but is
   not required.

2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
}
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"), "MIT-0": ("", "MIT No Attribution"), "ISC": ("", "ISC License"),
    "0BSD": ("", "BSD Zero Clause License"), "BSD-2-Clause": ("", "BSD 2-Clause License"), "BSD-3-Clause": ("", "BSD 3-Clause License"),
    "Zlib": ("", "zlib License"), "Apache-2.0": ("",),
}

# One-line notices by SPDX identifier.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC"),
}

# Digests of the canonical form of long licences' whole texts, as published, by SPDX name of the text.
DIGESTS = {
    "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9": "Apache-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f": "GFDL-1.2",
    "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4": "GFDL-1.3",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1": "GPL-2.0",
    "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f": "GPL-3.0",
    "e2c319279ddf282349927826fd110bdb5b471edc3a726a66fe333c8184a4b135": "LGPL-2.0",
    "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6": "MPL-1.1",
    "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56": "MPL-2.0",
    "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8": "Artistic-1.0",
    "0933e9fdf25f8a4aced10e10246650350123e13b939182f69b5ec6730ce2d793": "Apache-2.0",  # up to the appendix
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Both are read alike by Java, RE2 and Python (the latter by way of _python).
COPYRIGHT = r"(^|\n)[ \t#*/;>-]*(copyright |\(c\) |\x{A9} ?|portions copyright |all rights reserved)[^\n]*"
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}\x{A9}\x{2018}\x{2019}\x{201C}\x{201D}\x{2013}\x{2014}]+"


def _python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", pattern)


def canonical_lines(text: str) -> str:
    """The canonical form in Python, lines kept; used for the known texts."""
    text = text.translate(str.maketrans(_UPPER, _LOWER))
    text = re.sub(_python(MARKS), " ", re.sub(_python(COPYRIGHT), "\n", text))
    for spelling, canonical in SPELLINGS:
        text = text.replace(spelling, canonical)
    return text


def _digest(lines: str) -> str:
    return hashlib.sha256(re.sub(r"[ \n]+", " ", lines).strip(" ").encode()).hexdigest()


def known_texts() -> dict[str, str]:
    """Digest of each known whole text, with and without a title, to its identifier."""
    short = {_digest(canonical_lines(f"{title}\n\n{body}")): name for name, body in TEXTS.items() for title in TITLES[name]}
    return DIGESTS | short


def known_notices() -> dict[str, str]:
    """Canonical line of each known notice to its identifier."""
    return {re.sub(" +", " ", canonical_lines(x)).strip(" "): name for name, lines in NOTICES.items() for x in lines}


def canonical(text: Column) -> Column:
    """The canonical form of a column, lines kept."""
    text = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    text = F.regexp_replace(F.regexp_replace(text, COPYRIGHT, "\n"), MARKS, " ")
    for spelling, same in SPELLINGS:
        text = F.replace(text, F.lit(spelling), F.lit(same))
    return text


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_sha256, license, notices: one row per input row, repeated rows included.

    text_sha256 is the digest of the canonical text; license the identifier of the known text it is,
    null if none; notices the sorted identifiers of the known notices among its lines, comma-joined,
    empty if none.  A null text counts as empty.  Other columns take no part; an empty table gives an
    empty result.
    """
    notices = known_notices()
    digests = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in notices.items()}
    longest = max(map(len, notices))
    names = F.create_map(*(F.lit(x) for pair in sorted(digests.items()) for x in pair))
    lines = F.transform(F.split("__lines", "\n"), lambda x: F.trim(x))
    short = F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) <= longest))
    found = F.filter(F.transform(short, lambda x: names[F.sha2(x, 256)]), lambda x: x.isNotNull())
    whole = F.sha2(F.trim(F.regexp_replace("__lines", "[ \n]+", " ")), 256)
    marked = docs.select(F.col(f"`{key}`").alias("doc_id"), canonical(F.col(f"`{text}`")).alias("__lines"))
    marked = marked.select("doc_id", whole.alias("text_sha256"), F.array_join(F.sort_array(F.array_distinct(found)), ",").alias("notices"))
    # a constant of this module, some dozens of rows
    rows = ", ".join(f"('{digest}', '{name}')" for digest, name in sorted(known_texts().items()))
    known = docs.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS known(text_sha256, license)")
    return marked.join(F.broadcast(known), "text_sha256", "left").select("doc_id", "text_sha256", "license", "notices")


def sql() -> str:
    """The result of ``scan`` over documents, for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    text = f"regexp_replace(regexp_replace({text}, {quoted(COPYRIGHT)}, chr(10), 'g'), {quoted(MARKS)}, ' ', 'g')"
    for spelling, same in SPELLINGS:
        text = f"replace({text}, {quoted(spelling)}, {quoted(same)})"
    rows = lambda d: ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(d.items()))
    return f"""
WITH c AS (
  SELECT row_number() OVER () AS n, doc_id, {text} AS lines FROM documents
), known(d, license) AS (VALUES {rows(known_texts())}), notice(line, license) AS (VALUES {rows(known_notices())}),
l AS (
  SELECT n, trim(unnest(string_split(lines, chr(10))), ' ') AS line FROM c
), f AS (
  SELECT n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN notice USING (line) GROUP BY n
)
SELECT doc_id, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'), ' ')) AS text_sha256, license, coalesce(notices, '') AS notices
FROM c LEFT JOIN f USING (n) LEFT JOIN known ON d = sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'), ' '))
"""
