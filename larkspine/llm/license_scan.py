"""License scan by canonical digest lookup.

A text's canonical form drops copyright lines (one that goes on with a grant is dropped up to the grant), folds case, brings equivalent spellings to one, and makes every
run of punctuation and spaces one space.  Its SHA-256 is hash-joined to the digests of known licences.
The entire text is one unit; lines that speak of a licence are units too, since a notice is often one line
of a longer document, and so are two and three such lines in a row, joined, since a notice may wrap.  The table of known
licences is a constant of about a hundred rows (checked), so it is broadcast, and the documents are never shuffled.

Known are whole texts of the MIT, ISC, 0BSD, BSD, Apache, GPL, LGPL, MPL, CC0, GFDL, OFL, Blue Oak, Boost, Artistic, zlib
and Unlicense licences in their usual forms, and one-line notices and SPDX identifiers; callers pass further texts and digests.
AGPL and the other Creative Commons texts are not among them.

Defined cases: null and empty texts, and texts with nothing but copyright lines, have the digest of the empty
string and match nothing; a text that several known licences canonicalise to gets the first in order of name.  Repeated rows get
the same result each; texts of any length are hashed whole.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings, applied in this order to folded text.
SPELLINGS = (
    ("licence", "license"),
    ("sublicens", "sub-licens"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("fulfil ", "fulfill "),
    ("acknowledgement", "acknowledgment"),
    ("non-commercial", "noncommercial"),
    ("http://", "https://"),
    ("&", " and "),
)
COPYRIGHT = r"(?im)^[^\n]*(copyright (\(c\)|©|[0-9]|by)|\(c\) [0-9]|© ?[0-9]|all rights reserved)[^\n]*$"
#: What every copyright line holds one of, in lower case.
MARKERS = ("copyright ", "(c) ", "©", "all rights reserved")
#: Openings of grants.  One that stands on the line of a copyright notice starts a line of its own, so that the notice ends before it.
GRANT = r"(?i)(permission is hereby granted|permission to use, copy|redistribution and use in source|licen[cs]ed under|released under|released into the public domain|this work is licen[cs]ed|spdx-license-identifier)"
ABOUT = r"(?i)licen[cs]e|released under|public domain|spdx"
#: A bound that the broadcast table is checked against.
MOST_KNOWN = 10_000

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Known licence texts and one-line notices (identifier, text).
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("BSD-2-Clause", _BSD_TWO + "\n" + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_TWO + "\n" + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TWO + "\n" + _BSD_THIRD + "\n" + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_TWO + "\n" + _BSD_THIRD + "\n" + _BSD_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
)


#: SHA-256 of the canonical form of whole licence texts as they are published and commonly shipped (identifier, digest):
#: with and without title, appendix and postal address.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "a8735a1cc542f9d2359a2d3a2f854c4fb93fdbdf1f1b575cfb668c9d875be109"),
    ("Apache-2.0", "1e0f16037548f3624628bf0f8097b30df48e12b5eeab024f8e58d443eb640bcf"),
    ("Apache-2.0", "dc1a05fff17bceb21d7f12f494a6503a4623fbd070d4301dcbb2933cf3907834"),
    ("Apache-2.0", "cb95e03d3186b901553c0efd075c623f36bb65757cf9ea8e22bb78289fe6c279"),
    ("Apache-2.0", "3ac39d2cb9684b8dfda0a5f33d9f1855cf1e5a818b5c359d92d927e96af152f0"),
    ("Apache-2.0", "160c51e9f7e7e6487d4058753e2d4e5d323aa6dfc4e2c6e6bb59151de6bdbb5e"),
    ("Apache-2.0", "750b253f35a60d0b4ec5fef0635bb87e5170328ec3743060cd18fcff98d88070"),
    ("Apache-2.0", "745789739751538ad032e73f82d01bb37f936cdc5976d85b035dd168dc2c145d"),
    ("Apache-2.0 WITH LLVM-exception", "a03548d976b76f1552f27e4932ba66bcd5b0df987098b52fa9e8bc1c42dfb5dd"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-2-Clause", "032f33a9fad178d38ba062bc5f6e47fde5eb48f13d4c8895fe1360e806c83a69"),
    ("BSD-2-Clause", "1a346ec500e0e2a3b0635130743cb752397c1ab0a453dea1a45bea5bc6eaa44a"),
    ("BSD-2-Clause", "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "e36c57c376f1fac8945922863988e22c5e7460394aeb78fafeceef531dac4870"),
    ("BSD-2-Clause", "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374"),
    ("BSD-3-Clause", "526279aa5ce65fb23ffd45ae5430abc95af7bd6118ff94cc2842185ce6aa2c02"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("BSL-1.0", "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded"),
    ("BlueOak-1.0.0", "6cffa606d4960a0fadb3c8161a99b92c53dbe7b999697a5e26d35cfdc1d80f3d"),
    ("CC0-1.0", "f75535fb4e31444d2378110b0a3c612e1e0c167e0c3da47458c276d8d1da63fc"),
    ("GFDL-1.2", "d990fb1e743580be356801d20550814823991b97d8dedcfc0e264d83847b0acc"),
    ("GFDL-1.3", "3239b1e93fcc54a9a0a6e1f4a84704ff3747fd09892d3790b7902d9c1126b873"),
    ("GPL-1.0", "99bd291e59d8de45fdc7d5575f2f3ac50325b1b17e73f9e906cfb3eea3563763"),
    ("GPL-2.0", "17ac8ed5a9ee7b7f1627e3ba738641b2de2415674e547125ae3d2025ea694a64"),
    ("GPL-2.0", "47e68998855369660ee0dbb2b864f34190276ea16b091ad8cdb1a43796e703dc"),
    ("GPL-2.0", "dbfb2f7d8f936a60a1bad9ce5a55c19cd17a8e4e23af6777a15152288557cbd8"),
    ("GPL-2.0", "bd01a96aa44212662ad13b3596858c14e549fe37c9c924c32094d81621385a12"),
    ("GPL-3.0", "a596a2dda7bcae27fefe450f2c9d35069ca10070f301199b58f4d9432b6f9393"),
    ("GPL-3.0", "05799a9a4e601e9d14a2d80b2d64abe2535b0f74069e562cf9056c09634c8c37"),
    ("ISC", "4407eb89dd3b0fb495b4681ddb0526c6aa98fdc9db3bfc4706579b2504e26fcd"),
    ("ISC", "23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1"),
    ("ISC", "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("ISC", "2b614fb2c18253fb7c1d5d24276593e12d81b854b5e79442a26885adc7ddc0c0"),
    ("LGPL-2.0", "5df277a264b0db9f656dea052fa76d8fbe46620768b01b8f09f76ef719771d95"),
    ("LGPL-2.0", "9da5228f84b8b92dd90ba13b57a1c7d73570502858fcc5a009a57bd9c01bf957"),
    ("LGPL-2.1", "30e14ac0282ce9ba390dbdff596aec7f8ed6556482d37ebe51cc1f05b539dcec"),
    ("LGPL-2.1", "659bfcbba21e743ae02dd4d5518f6bf275275dfe701b5ff9c9b8d21e24d85589"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", "3ed9930ead1d5fef9502e879ec49b95d164dc3e2ff86822e932077064de7b6fe"),
    ("MIT", "5c60022aed9821843e87069f14a946877d59d3ef5a629c75073dacbad8df3e35"),
    ("MIT", "4aeb4a99037dbaffcfe99ada4883836fc536c03dd4acdbd49d2fa34f078f42c3"),
    ("MPL-1.1", "ed3247662f3294e1935df326ae332c6bd31eac75c6b588974b1b557bda1bdf94"),
    ("MPL-2.0", "5b99aee7d3c26ef14d487a6c42592c8e587179c8e4e5adc09e9c70a2cdc54f08"),
    ("OFL-1.1", "9ed938884de5c7f02c09e30cb308a038f301705cd4b00bd59298246fffb6506d"),
    ("Unlicense", "8d3909f4543649cfba0b0b1fc765c67acf3736106a78237ea2972f83eaa7dd3e"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
)
#: Licences whose SPDX identifier alone is a notice.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib")
KNOWN += tuple((x, "SPDX-License-Identifier: " + x) for x in SPDX)


def canonical(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    folded = F.lower(text)
    noticed = reduce(or_, (folded.contains(m) for m in MARKERS))  # the patterns are tried on few texts
    out = F.when(noticed, F.lower(F.regexp_replace(F.regexp_replace(text, GRANT, "\n$1"), COPYRIGHT, ""))).otherwise(folded)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))


def known_digests(spark, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """digest, license: one row per digest."""
    if len(known) + len(digests) > MOST_KNOWN:
        raise ValueError("too many known licences to broadcast")
    rows = spark.createDataFrame(list(known), "license string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    rows = rows.union(spark.createDataFrame([(d, x) for x, d in digests], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """doc_id, canon_sha256, license (of the entire text, else null), notices (sorted licences of its lines)."""
    table = known_digests(docs.sparkSession, known, digests)
    pairs = sorted((r["digest"], r["license"]) for r in table.collect())
    by_digest = F.map_from_arrays(F.array(*[F.lit(p[0]) for p in pairs]), F.array(*[F.lit(p[1]) for p in pairs])) if pairs else F.expr("cast(map() as map<string,string>)")
    text = F.col("text").cast("string")
    # A unit is a line that speaks of a licence, alone or with the one or two lines after it.  Each line is made canonical once, and
    # canonical lines are joined: no rule but the one that joins parts by a space looks beyond a line.
    lines = F.when(text.rlike(ABOUT), F.split(text, "\n")).otherwise(F.array().cast("array<string>"))
    starts = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(ABOUT), F.slice(lines, i + 1, F.lit(3)))), lambda u: u.isNotNull())
    joined = lambda parts, n: F.concat_ws(" ", F.filter(F.slice(parts, 1, n), lambda x: x != ""))
    units = F.flatten(F.transform(F.transform(starts, lambda three: F.transform(three, canonical)), lambda c: F.array(*(joined(c, n) for n in (1, 2, 3)))))
    found = F.filter(F.transform(units, lambda unit: F.try_element_at(by_digest, F.sha2(unit, 256))), lambda x: x.isNotNull())
    scanned = docs.select("doc_id", F.sha2(canonical(text), 256).alias("canon_sha256"), F.array_sort(F.array_distinct(found)).alias("notices"))
    return scanned.join(F.broadcast(table), F.col("canon_sha256") == F.col("digest"), "left").select("doc_id", "canon_sha256", "license", "notices")


def license_sql() -> str:
    """The same as SQL for DuckDB, over ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace(coalesce({x}, ''), {q(GRANT)}, chr(10) || '\\1', 'g')"
        out = f"lower(regexp_replace({out}, {q(COPYRIGHT)}, '', 'g'))"
        for a, b in SPELLINGS:
            out = f"replace({out}, {q(a)}, {q(b)})"
        return f"trim(regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"

    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    more = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN_DIGESTS)
    after = lambda k: f"chr(10) || coalesce(lines[i + {k}], '')"
    return f"""
        WITH known AS (
            SELECT digest, min(l) AS license
            FROM (SELECT sha256({canon('t')}) AS digest, l FROM (VALUES {values}) v(l, t) UNION ALL SELECT digest, l FROM (VALUES {more}) v(l, digest)) x GROUP BY 1),
        d AS (SELECT doc_id, sha256({canon('text')}) AS canon_sha256, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        u AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d),
        s AS (SELECT doc_id, unnest([lines[i], lines[i] || {after(1)}, lines[i] || {after(1)} || {after(2)}]) AS unit FROM u WHERE regexp_matches(lines[i], {q(ABOUT)})),
        n AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS notices FROM s JOIN known ON sha256({canon('unit')}) = digest GROUP BY doc_id)
        SELECT d.doc_id, d.canon_sha256, known.license, coalesce(n.notices, []::VARCHAR[]) AS notices
        FROM d LEFT JOIN known ON d.canon_sha256 = known.digest LEFT JOIN n USING (doc_id)"""
