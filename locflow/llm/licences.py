"""Operator 1: licence scan by ordered signature rules.

A text is lower-cased (A-Z only), cut into words and joined by single
spaces; every rule is a regular expression over that form. A rule has a
keyword, one of the words it needs: only rules whose keyword is among a
text's distinct words are tried (most texts try none). Rules are ordered by
priority: an SPDX tag beats a full name, which beats a short name. A
detection whose words lie inside another one's, of equal or higher
priority, is suppressed. Base phrases are detections that are always kept.

All of it is a map over the rows: no shuffle, memory bounded by one block of
texts; a lost task is run again.

Defined cases: a null or empty text has no words, no detection and score 0;
null ids are kept; repeated rows give equal rows; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.llm.shared import pieces

BLOCK_CHARS = 1 << 20

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public SPDX identifiers, looked for after an SPDX tag and after the words "license" or "licensed under".
SPDX = """
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0
apache-1.1 apache-2.0 apsl-1.0 apsl-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0 blueoak-1.0.0 bsd-1-clause
bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsd-source-code bsl-1.0 busl-1.1
cc-pddc cc0-1.0 cddl-1.0 cddl-1.1 cdla-permissive-1.0 cdla-permissive-2.0 cdla-sharing-1.0 cecill-2.0 cecill-2.1
cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-1.0 ecl-2.0 efl-2.0 epl-1.0 epl-2.0 etalab-2.0 eupl-1.0 eupl-1.1
eupl-1.2 fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only
gpl-3.0-or-later hpnd icu ijg imagemagick ipl-1.0 isc jpnic json lgpl-2.0 lgpl-2.1 lgpl-2.1-only
lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later libpng-2.0 lpl-1.02 lppl-1.3c mit mit-0 mpl-1.0
mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-1.0 osl-2.0
osl-2.1 osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat spl-1.0 sspl-1.0
unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zlib-acknowledgement zpl-2.0 zpl-2.1
""".split()

# Terms of Creative Commons licences, their long names and the versions they came in.
CC_TERMS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial",
            "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
            "by nc sa": "attribution non ?commercial share ?alike",
            "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Families whose bare "name version" is a licence wherever it stands; other names (Python 2.0, PHP 3.0) need a licence word.
BARE = frozenset("""0bsd aal afl agpl apsl blueoak bsd busl cc0 cddl cdla cecill epl etalab eupl gfdl gpl lgpl lppl mpl ms mulanpsl
odbl odc ofl osl pddl qpl sspl""".split())

# Written by hand: label, keyword, expression over the joined words. ``@2.1`` is a version as people write it: behind
# "version", "ver" or "v", with a v of its own, or bare; a minor 0 may be missing.
NAMES = r"""
apache-1.0|apache|(?:the )?apache (?:software )?licen[cs]e@1.0
apache-1.1|apache|(?:the )?apache (?:software )?licen[cs]e@1.1
apache-2.0|apache|(?:the )?apache (?:software )?licen[cs]e@2.0
apache-2.0|apache|(?:licen[cs]ed|released|distributed|available) under (?:the )?apache@2.0
apache-2.0|apache2|apache2 licen[cs]ed?
apache-2.0|asl|asl@2.0
apache|apache|the apache (?:software )?licen[cs]e
apache|apache|apache licensed
mit|mit|(?:the |under |under the )?mit licen[cs]e
mit|mit|mit (?:style )?licen[cs]ed
mit|mit|(?:licen[cs]ed|released|distributed) under (?:the )?mit
mit|permission|permission is hereby granted free of charge to any person obtaining a copy
mit|noninfringement|the warranties of merchantability fitness for a particular purpose and noninfringement
mit-0|attribution|mit no attribution(?: licen[cs]e)?
mit-0|mit|mit 0 licen[cs]e
x11|x11|x11 licen[cs]ed?
isc|isc|(?:the )?isc licen[cs]ed?
isc|distribute|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd|bsd|(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?
bsd|bsd|bsd(?: style| type)? licen[cs]ed?
bsd|bsd|(?:licen[cs]ed|released|distributed) under (?:the )?bsd
bsd-2-clause|bsd|(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]ed?)?
bsd-2-clause|freebsd|freebsd licen[cs]e
bsd-3-clause|bsd|(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]ed?)?
bsd-3-clause|endorse|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|bsd|(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]ed?)?
bsd-4-clause|advertising|all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd|redistribution|redistribution and use in source and binary forms with or without modification
gpl-1.0|gnu|gnu general public licen[cs]e@1.0
gpl-2.0|gnu|gnu general public licen[cs]e@2.0
gpl-3.0|gnu|gnu general public licen[cs]e@3.0
gpl-2.0-or-later|gnu|gnu general public licen[cs]e@2.0 (?:of the licen[cs]e )?or (?:at your option )?(?:any )?(?:later|newer)
gpl-3.0-or-later|gnu|gnu general public licen[cs]e@3.0 (?:of the licen[cs]e )?or (?:at your option )?(?:any )?(?:later|newer)
gpl-2.0-or-later|option|either version 2 of the licen[cs]e or at your option any later version
gpl-3.0-or-later|option|either version 3 of the licen[cs]e or at your option any later version
gpl|gnu|gnu (?:gpl|general public licen[cs]e)
gpl|gpl|(?:under|by|of) (?:the )?(?:terms of the )?gpl
gpl|gpl|gpl(?: compatible)? licen[cs]ed?
gpl|gpled|gpled
gpl-1.0|gpl|(?:gnu )?gpl@1.0
gpl-2.0|gpl|(?:gnu )?gpl@2.0
gpl-3.0|gpl|(?:gnu )?gpl@3.0
gpl-2.0-only|gpl|(?:gnu )?gpl@2.0 only
gpl-3.0-only|gpl|(?:gnu )?gpl@3.0 only
gpl-2.0-or-later|gpl|(?:gnu )?gpl@2.0 or (?:any )?(?:later|newer|above)
gpl-3.0-or-later|gpl|(?:gnu )?gpl@3.0 or (?:any )?(?:later|newer|above)
gpl-2.0|gplv2|gplv2(?: 0)?
gpl-3.0|gplv3|gplv3(?: 0)?
gpl-2.0-only|gplv2|gplv2(?: 0)? only
gpl-3.0-only|gplv3|gplv3(?: 0)? only
gpl-2.0-or-later|gplv2|gplv2(?: 0)? or (?:any )?(?:later|newer|above)
gpl-3.0-or-later|gplv3|gplv3(?: 0)? or (?:any )?(?:later|newer|above)
gpl-2.0|gpl2|gpl2
gpl-3.0|gpl3|gpl3
lgpl-2.0|gnu|gnu library general public licen[cs]e@2.0
lgpl-2.1|lesser|(?:gnu )?lesser general public licen[cs]e@2.1
lgpl-3.0|lesser|(?:gnu )?lesser general public licen[cs]e@3.0
lgpl|lesser|(?:gnu )?lesser general public licen[cs]e
lgpl|library|gnu library general public licen[cs]e
lgpl|gnu|gnu lgpl
lgpl|lgpl|(?:under|by|of) (?:the )?lgpl
lgpl|lgpl|lgpl licen[cs]ed?
lgpl-2.0|lgpl|(?:gnu )?lgpl@2.0
lgpl-2.1|lgpl|(?:gnu )?lgpl@2.1
lgpl-3.0|lgpl|(?:gnu )?lgpl@3.0
lgpl-2.1-or-later|lgpl|(?:gnu )?lgpl@2.1 or (?:any )?(?:later|newer|above)
lgpl-3.0-or-later|lgpl|(?:gnu )?lgpl@3.0 or (?:any )?(?:later|newer|above)
lgpl-2.0|lgplv2|lgplv2(?: 0)?
lgpl-2.1|lgplv2|lgplv2 1
lgpl-3.0|lgplv3|lgplv3(?: 0)?
lgpl-2.1|lgpl2|lgpl2 1
lgpl-3.0|lgpl3|lgpl3
agpl-3.0|affero|(?:gnu )?affero general public licen[cs]e@3.0
agpl|affero|(?:gnu )?affero general public licen[cs]e
agpl-3.0|agpl|(?:gnu )?agpl@3.0
agpl-3.0|agplv3|agplv3(?: 0)?
agpl|agpl|(?:gnu agpl|agpl licen[cs]ed?|under the agpl)
gfdl-1.1|documentation|gnu free documentation licen[cs]e@1.1
gfdl-1.2|documentation|gnu free documentation licen[cs]e@1.2
gfdl-1.3|documentation|gnu free documentation licen[cs]e@1.3
gfdl|documentation|gnu free documentation licen[cs]e
gfdl|gfdl|(?:gnu gfdl|gfdl licen[cs]ed?|under the gfdl)
gpl-exception|exception|(?:classpath|gcc runtime library|linking|autoconf|bison|font) exception
mpl-1.0|mozilla|mozilla public licen[cs]e@1.0
mpl-1.1|mozilla|mozilla public licen[cs]e@1.1
mpl-2.0|mozilla|mozilla public licen[cs]e@2.0
mpl|mozilla|mozilla public licen[cs]e
mpl-1.1|mpl|mpl@1.1
mpl-2.0|mpl|mpl@2.0
mpl-2.0|mplv2|mplv2(?: 0)?
mpl|mpl|(?:under the mpl|mpl licen[cs]ed?)
mpl-2.0|incompatible|incompatible with secondary licenses
epl-1.0|eclipse|eclipse public licen[cs]e@1.0
epl-2.0|eclipse|eclipse public licen[cs]e@2.0
epl|eclipse|eclipse public licen[cs]e
epl-1.0|epl|epl@1.0
epl-2.0|epl|epl@2.0
edl-1.0|eclipse|eclipse distribution licen[cs]e@1.0
cddl-1.0|cddl|(?:the )?cddl@1.0
cddl-1.1|cddl|(?:the )?cddl@1.1
cddl|cddl|(?:the )?cddl
cddl-1.0|distribution|common development and distribution licen[cs]e@1.0
cddl|distribution|common development and distribution licen[cs]e
cpl-1.0|common|common public licen[cs]e(?: version)?(?: 1 0)?
cpal-1.0|common|common public attribution licen[cs]e@1.0
ipl-1.0|ibm|ibm public licen[cs]e@1.0
apsl-2.0|apple|apple public source licen[cs]e@2.0
apsl|apple|apple public source licen[cs]e
nosl|netscape|netscape public licen[cs]e
spl-1.0|sun|sun public licen[cs]e@1.0
eupl-1.1|eupl|eupl@1.1
eupl-1.2|eupl|eupl@1.2
eupl|eupl|eupl
eupl-1.2|european|european union public licen[cs]e@1.2
eupl|european|european union public licen[cs]e
osl-3.0|open|open software licen[cs]e@3.0
osl|open|open software licen[cs]e
afl-3.0|academic|academic free licen[cs]e@3.0
afl|academic|academic free licen[cs]e
ecl-2.0|educational|educational community licen[cs]e@2.0
ecl|educational|educational community licen[cs]e
artistic-1.0|artistic|(?:the )?artistic licen[cs]e@1.0
artistic-2.0|artistic|(?:the )?artistic licen[cs]e@2.0
artistic|artistic|(?:perl |the |clarified )?artistic licen[cs]e
artistic|perl|same terms as perl(?: itself)?
bsl-1.0|boost|boost software licen[cs]e(?: version)?(?: 1 0)?
busl-1.1|business|business source licen[cs]e(?: version)?(?: 1 1)?
sspl-1.0|server|server side public licen[cs]e
elastic-2.0|elastic|elastic licen[cs]e@2.0
elastic|elastic|elastic licen[cs]e
commons-clause|clause|commons clause(?: licen[cs]e)?(?: condition)?
polyform|polyform|polyform (?:noncommercial|small business|free trial|perimeter|shield|strict|internal use) licen[cs]e
fsl|functional|functional source licen[cs]e
rail|rail|(?:open )?rail(?: m| s)? licen[cs]e
openrail|openrail|(?:creativeml |bigscience |bigcode )?openrail(?: m)?
llama|llama|llama (?:2 |3 |3 1 )?community licen[cs]e(?: agreement)?
zlib|zlib|zlib(?: libpng)? licen[cs]ed?
zlib|altered|altered source versions must be plainly marked as such
libpng|libpng|libpng licen[cs]e
ijg|jpeg|independent jpeg group
ftl|freetype|freetype (?:project )?licen[cs]e
imagemagick|imagemagick|imagemagick licen[cs]e
curl|curl|curl licen[cs]e
icu|icu|icu licen[cs]e
unicode|unicode|unicode(?: inc)? licen[cs]e agreement
unlicense|unlicense|the unlicense
unlicense|unlicense|unlicense licen[cs]ed?
unlicense|unencumbered|free and unencumbered software released into the public domain
public-domain|domain|(?:released|placed|dedicated|put|donated|entered) (?:in|into|to) the public domain
public-domain|domain|(?:is|are|be|now|works?) in the public domain
public-domain|domain|public domain (?:dedication|mark|software|works?|licen[cs]e|material|image|text)
wtfpl|wtfpl|wtfpl
wtfpl|fuck|do what the fuck you want to public licen[cs]e
beerware|beerware|beerware(?: licen[cs]e)?
beerware|beer|(?:the )?beer ware licen[cs]e
ofl-1.1|ofl|sil ofl(?: 1 1)?
ofl-1.1|sil|sil open font licen[cs]e(?: version)?(?: 1 1)?
ofl|font|open font licen[cs]e
fsfap|offered|this file is offered as is without any warranty
cc0-1.0|cc0|cc0(?: 1 0)?(?: universal)?
cc0-1.0|zero|creative commons zero(?: v?1 0)?
cc0-1.0|universal|1 0 universal public domain dedication
creative-commons|commons|creative commons(?: licen[cs]ed?)?
creative-commons|creativecommons|creativecommons org licenses
cc-by-sa|share|attribution share ?alike
odbl-1.0|odbl|odbl(?: 1 0)?
odbl-1.0|database|open data(?:base)? commons open database licen[cs]e
odbl-1.0|database|open database licen[cs]e
odc-by-1.0|commons|open data commons attribution licen[cs]e
pddl-1.0|pddl|pddl(?: 1 0)?
pddl-1.0|dedication|public domain dedication and licen[cs]e
ogl-uk|government|open government licen[cs]e
cdla|community|community data licen[cs]e agreement
etalab-2.0|ouverte|licence ouverte(?: open licence)?
python-2.0|python|python software foundation licen[cs]e
python-2.0|psf|psf licen[cs]ed?
php|php|php licen[cs]e(?: version)?(?: 3 0[01]?)?
postgresql|postgresql|postgresql licen[cs]ed?
openssl|openssl|openssl licen[cs]e
ruby|ruby|ruby licen[cs]e
vim|vim|vim licen[cs]e
zpl|zope|zope public licen[cs]e
ncsa|ncsa|(?:university of illinois )?ncsa open source licen[cs]e
ncsa|illinois|university of illinois open source licen[cs]e
sleepycat|sleepycat|sleepycat licen[cs]e
tcl|tcl|tcl tk licen[cs]e
w3c|w3c|w3c (?:software |document )(?:notice and )?licen[cs]e
lppl|latex|latex project public licen[cs]e
ms-pl|microsoft|microsoft public licen[cs]e
ms-rl|microsoft|microsoft reciprocal licen[cs]e
ms-eula|microsoft|microsoft software licen[cs]e terms
mulanpsl-2.0|mulan|mulan permissive software licen[cs]e
cecill|cecill|cecill(?: [bc])? ?licen[cs]e?
cecill|cecill|(?:under|of) (?:the )?cecill
commercial|commercial|commercial licen[cs]e (?:agreement|terms|key|fee)
commercial|commercial|(?:under|purchase|buy|obtain|require) (?:a |an |the )?commercial licen[cs]e
noncommercial|commercial|for non ?commercial (?:use|purposes) only
noncommercial|noncommercial|for noncommercial (?:use|purposes) only
proprietary|proprietary|proprietary (?:and confidential|licen[cs]e|software)
proprietary|confidential|confidential and proprietary
evaluation|evaluation|for (?:internal )?evaluation (?:use|purposes) only
eula|user|end user licen[cs]e agreement
eula|eula|(?:this|the) eula
no-redistribution|redistribute|(?:do not|may not|must not) (?:copy or )?redistribute
no-redistribution|reproduced|(?:may not|must not|may be neither) be reproduced
no-redistribution|permission|without (?:the )?(?:express |prior |express prior |prior express )?written permission
reserved|rights|(?:some|no) rights reserved
dual|dual|dual licen[cs]ed
as-is|warranty|provided (?:as is|as is and) without (?:any )?(?:express or implied )?warranty
copyright|copyright|copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*
copyleft|copyleft|copyleft
"""


class Rule(NamedTuple):
    label: str
    priority: int           # smaller is stronger
    confidence: float
    keyword: bytes
    pattern: re.Pattern
    base: bool


def words_of(label: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", label))


def version(major: str, minor: str) -> str:
    return rf" (?:version |ver |v )?v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: some 220 written by hand, and those of the tables of identifiers."""
    out = []

    def rule(label, priority, confidence, keyword, expression, base=False):
        pattern = re.compile(rf"(?<= )(?:{expression})(?= )".encode())
        out.append(Rule(label, priority, confidence, keyword.encode(), pattern, base))

    for name in SPDX:
        w = words_of(name)
        rule(name, 1, 0.99, "spdx", rf"spdx license identifier {w}")
        rule(name, 2, 0.95, w.split(" ")[0], rf"licen[cs]ed? (?:under |by |as |with )?(?:the |terms of the )?{w}")
        if " " in w and w.split(" ")[0] in BARE:
            rule(name, 4, 0.8, w.split(" ")[0], w)
    for terms, long in CC_TERMS.items():
        label = "cc-" + terms.replace(" ", "-")
        for v in CC_VERSIONS:
            full = f"{label}-{v.replace(' ', '.')}"
            rule(full, 2, 0.97, "cc", rf"cc {terms} {v}(?: [a-z][a-z])?")
            rule(full, 2, 0.97, "creativecommons", rf"creativecommons org licenses {terms} {v}")
            rule(full, 2, 0.97, "commons", rf"creative commons {long} {v}(?: international| unported| generic)?")
        rule(label, 3, 0.9, "cc", rf"cc {terms}")
        rule(label, 3, 0.9, "commons", rf"creative commons {long}")
    for line in NAMES.strip().splitlines():
        label, keyword, expression = line.split("|", 2)
        expression = re.sub(r"@([0-9]+)\.([0-9]+)", lambda m: version(*m.groups()), expression)
        rule(label, 3, 0.85, keyword, expression)
    for phrase, label in BASE.items():
        rule(label, 3, 0.9, phrase.split(" ")[-1], phrase, base=True)
    return tuple(sorted(out, key=lambda r: r.priority))


@lru_cache(maxsize=1)
def by_keyword() -> dict[bytes, list[int]]:
    index: dict[bytes, list[int]] = {}
    for i, r in enumerate(rules()):
        index.setdefault(r.keyword, []).append(i)
    return index


# Bytes that stand in words: digits, lower-case letters and all of non-ASCII (after A-Z are lowered).
IN_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def detect(text: str) -> tuple[int, list[tuple[str, int, int, int, bool, float]]]:
    """Number of words, and the kept detections: label, rule, first word, past word, base, confidence."""
    words = text.encode("utf-8", "replace").lower().translate(IN_WORDS).split()
    index = by_keyword()
    tried = sorted({i for k in index.keys() & set(words) for i in index[k]})
    if not tried:
        return len(words), []
    joined = b" " + b" ".join(words) + b" "
    found = [(m.start(), m.end(), rules()[i].priority, i) for i in tried for m in rules()[i].pattern.finditer(joined)]
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    kept, reach = [], [0] * 6   # the furthest end among detections of each priority so far
    for start, end, priority, i in found:
        inside = max(reach[:priority + 1]) >= end
        if not rules()[i].base:
            reach[priority] = max(reach[priority], end)
        if rules()[i].base or not inside:
            kept.append((start, end, i))
    out, at, seen = [], 0, -1   # words counted along the text
    for start, end, i in kept:
        seen += joined.count(b" ", at, start)
        at = start
        r = rules()[i]
        out.append((r.label, i, seen, seen + joined.count(b" ", start, end) + 1, r.base, r.confidence))
    return len(words), out


DETECTION = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("first", pa.int64()), ("past", pa.int64()),
                       ("base", pa.bool_()), ("confidence", pa.float64())])
DETECTIONS = "array<struct<label:string,rule:int,first:bigint,past:bigint,base:boolean,confidence:double>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words`` and ``detections`` (label, rule, first and past word, base)."""
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            id_type = batch.schema.field("id").type
            for rows in pieces(batch, ("id", "text"), lambda r: len(r[1]), BLOCK_CHARS):
                found = [detect(r[1]) for r in rows]
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([r[0] for r in rows], id_type),
                    "n_words": pa.array([n for n, _ in found], pa.int64()),
                    "detections": pa.array([[dict(zip(("label", "rule", "first", "past", "base", "confidence"), d))
                                             for d in ds] for _, ds in found], pa.list_(DETECTION))})

    return source.mapInArrow(run, f"id {kind}, n_words bigint, detections {DETECTIONS}").withColumnRenamed("id", id_col)


def summary(df: DataFrame) -> DataFrame:
    """Per document: word count, base places, first and last base word, labels and a score."""
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    first = F.transform("base_places", lambda d: d["first"])
    missed = F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1 - d["confidence"]))
    return scan(df).withColumn("base_places", base).select(
        "doc_id", "n_words", F.size("base_places").cast("bigint").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        labels("base_places").alias("base_labels"), labels("detections").alias("labels"),
        (1 - missed).alias("score"), F.size("detections").cast("bigint").alias("n_detections"))
