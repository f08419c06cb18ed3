"""Signatures of licenses: patterns over words, each with a label, a keyword that every match contains, and a priority.

A pattern is a row of regular expressions, one for each word; a word with `?` behind it may be missing. Words are lower case and hold letters and
digits alone, so GPL-3.0 is `gpl 3 0`. `LIC` stands for license or licence. Priorities, the best first: 0 a tag or a sentence of a license's text
or notice, 1 a name with its version, or one that has none, 2 the name of a family, 3 an identifier beside a hint.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    priority: int
    pattern: str


#: How sure a detection of each priority is.
SURE = (1.0, 0.95, 0.8, 0.5)

#: label | keyword, identifier | keyword, name. An identifier or a name may be missing.
_NAMES = """
mit | mit, mit | mit, mit LIC
mit | expat, expat | expat, expat LIC
mit-0 | mit, mit 0 | mit, mit no attribution LIC?
x11 | x11, x11 | x11, x11 LIC
isc | isc, isc | isc, isc LIC
0bsd | 0bsd, 0bsd | bsd, zero clause bsd LIC?
bsd-1-clause | bsd, bsd 1 clause | bsd, (1|one) clause bsd LIC?
bsd-2-clause | bsd, bsd 2 clause | bsd, (2|two) clause bsd LIC?
bsd-2-clause | freebsd, freebsd | freebsd, freebsd LIC
bsd-2-clause | bsd, bsd 2 | bsd, simplified bsd LIC
bsd-3-clause | bsd, bsd 3 clause | bsd, (3|three) clause bsd LIC?
bsd-3-clause | bsd, bsd 3 | bsd, (new|modified|revised) bsd LIC
bsd-3-clause-clear | bsd, bsd 3 clause clear | bsd, clear bsd LIC
bsd-4-clause | bsd, bsd 4 clause | bsd, (4|four) clause bsd LIC?
bsd-4-clause | bsd, bsd 4 | bsd, (original|old) bsd LIC
apache-1.0 | apache, apache 1 0 | apache, apache software? LIC (version|v)? (1|v1) 0
apache-1.1 | apache, apache 1 1 | apache, apache software? LIC (version|v)? (1|v1) 1
apache-2.0 | apache, apache 2 0 | apache, apache software? LIC (version|v)? (2|v2) 0?
apache-2.0 | asl, asl (2|v2) 0? | alv2, alv2
gpl-1.0 | gpl, gpl (1|v1) 0? | general, general public LIC gpl? (version|v) (1|v1) 0?
gpl-2.0 | gpl, gpl (2|v2) 0? | general, general public LIC gpl? (version|v)? (2|v2) 0?
gpl-2.0 | gplv2, gplv2 | gpl2, gpl2
gpl-2.0-or-later | gpl, gpl (2|v2) 0? or later | general, general public LIC gpl? (version|v)? (2|v2) 0? or at? your? option? (any|later) later? version?
gpl-3.0 | gpl, gpl (3|v3) 0? | general, general public LIC gpl? (version|v)? (3|v3) 0?
gpl-3.0 | gplv3, gplv3 | gpl3, gpl3
gpl-3.0-or-later | gpl, gpl (3|v3) 0? or later | general, general public LIC gpl? (version|v)? (3|v3) 0? or at? your? option? (any|later) later? version?
lgpl-2.0 | lgpl, lgpl (2|v2) 0 | general, (library|lesser) general public LIC lgpl? (version|v)? (2|v2) 0?
lgpl-2.1 | lgpl, lgpl (2|v2) 1 | general, (library|lesser) general public LIC lgpl? (version|v)? (2|v2) 1
lgpl-2.1 | lgplv2, lgplv2 1? | lgpl2, lgpl2 1?
lgpl-3.0 | lgpl, lgpl (3|v3) 0? | general, lesser general public LIC lgpl? (version|v)? (3|v3) 0?
lgpl-3.0 | lgplv3, lgplv3 | lgpl3, lgpl3
agpl-1.0 | agpl, agpl (1|v1) 0? | affero, affero general public LIC agpl? (version|v)? (1|v1) 0?
agpl-3.0 | agpl, agpl (3|v3) 0? | affero, affero general public LIC agpl? (version|v)? (3|v3) 0?
agpl-3.0 | agplv3, agplv3 | agpl3, agpl3
gfdl-1.1 | gfdl, gfdl (1|v1) 1 | documentation, free documentation LIC gfdl? (version|v)? (1|v1) 1
gfdl-1.2 | gfdl, gfdl (1|v1) 2 | documentation, free documentation LIC gfdl? (version|v)? (1|v1) 2
gfdl-1.3 | gfdl, gfdl (1|v1) 3 | documentation, free documentation LIC gfdl? (version|v)? (1|v1) 3
mpl-1.0 | mpl, mpl (1|v1) 0 | mozilla, mozilla public LIC mpl? (version|v)? (1|v1) 0
mpl-1.1 | mpl, mpl (1|v1) 1 | mozilla, mozilla public LIC mpl? (version|v)? (1|v1) 1
mpl-2.0 | mpl, mpl (2|v2) 0? | mozilla, mozilla public LIC mpl? (version|v)? (2|v2) 0?
npl-1.0 | npl, npl 1 0 | netscape, netscape public LIC (version|v)? 1 0
epl-1.0 | epl, epl (1|v1) 0? | eclipse, eclipse public LIC epl? (version|v)? (1|v1) 0?
epl-2.0 | epl, epl (2|v2) 0? | eclipse, eclipse public LIC epl? (version|v)? (2|v2) 0?
edl-1.0 | edl, edl (1|v1) 0? | eclipse, eclipse distribution LIC edl? (version|v)? (1|v1) 0?
cddl-1.0 | cddl, cddl (1|v1) 0? | common, common development and distribution LIC cddl? (version|v)? (1|v1) 0?
cddl-1.1 | cddl, cddl (1|v1) 1 | common, common development and distribution LIC cddl? (version|v)? (1|v1) 1
cpl-1.0 | cpl, cpl (1|v1) 0? | common, common public LIC cpl? (version|v)? (1|v1) 0?
cpal-1.0 | cpal, cpal 1 0 | attribution, common public attribution LIC (version|v)? 1? 0?
ipl-1.0 | ipl, ipl 1 0 | ibm, ibm public LIC (version|v)? 1? 0?
eupl-1.1 | eupl, eupl (1|v1) 1 | union, european union public LIC eupl? (version|v)? (1|v1) 1
eupl-1.2 | eupl, eupl (1|v1) 2 | union, european union public LIC eupl? (version|v)? (1|v1) 2
artistic-1.0 | artistic, artistic 1 0 | artistic, artistic LIC (version|v)? (1|v1) 0?
artistic-2.0 | artistic, artistic 2 0 | artistic, artistic LIC (version|v)? (2|v2) 0?
afl-2.1 | afl, afl 2 1 | academic, academic free LIC (version|v)? 2 1
afl-3.0 | afl, afl 3 0 | academic, academic free LIC (version|v)? 3 0
osl-2.1 | osl, osl 2 1 | open, open software LIC (version|v)? 2 1
osl-3.0 | osl, osl 3 0 | open, open software LIC (version|v)? 3 0
nposl-3.0 | nposl, nposl 3 0 | profit, non profit open software LIC (version|v)? 3? 0?
apsl-1.2 | apsl, apsl 1 2 | apple, apple public source LIC (version|v)? 1 2
apsl-2.0 | apsl, apsl 2 0 | apple, apple public source LIC (version|v)? 2 0
ms-pl | ms, ms pl | microsoft, microsoft public LIC
ms-rl | ms, ms rl | microsoft, microsoft reciprocal LIC
ms-lpl | ms, ms lpl | microsoft, microsoft limited public LIC
bsl-1.0 | bsl, bsl 1 0 | boost, boost software LIC (version|v)? 1? 0?
busl-1.1 | busl, busl 1 1 | business, business source LIC (version|v)? 1? 1?
elastic-2.0 | elv2, elv2 | elastic, elastic LIC (version|v)? 2? 0?
sspl-1.0 | sspl, sspl 1? 0? | server, server side public LIC (version|v)? 1? 0?
commons-clause | clause, commons clause | clause, commons clause LIC condition
zlib | zlib, zlib | zlib, zlib LIC
libpng-2.0 | libpng, libpng 2 0 | libpng, libpng LIC (version|v)? 2?
wtfpl | wtfpl, wtfpl | fuck, do what the fuck you want to public LIC
unlicense | unlicense, unlicense | unlicense, the unlicense
beerware | beerware, beerware | beer, beer ware LIC
cc0-1.0 | cc0, cc0 1? 0? | zero, creative commons zero (version|v)? (1|v1)? 0? universal?
pddl-1.0 | pddl, pddl 1 0 | dedication, public domain dedication and LIC
odbl-1.0 | odbl, odbl 1? 0? | database, open (data)? (commons)? (open)? database LIC
odc-by-1.0 | odc, odc by 1? 0? | commons, open data commons attribution LIC
ofl-1.1 | ofl, ofl 1? 1? | font, sil? open font LIC (version|v)? 1? 1?
postgresql | postgresql, postgresql | postgresql, postgresql LIC
python-2.0 | psf, psf 2 0 | python, python software foundation LIC (version|v)? 2?
php-3.01 | php, php 3 01 | php, php LIC (version|v)? 3 01
php-3.0 | php, php 3 0 | php, php LIC (version|v)? 3 0
ruby | ruby, ruby | ruby, ruby LIC
openssl | openssl, openssl | openssl, openssl LIC
ncsa | ncsa, ncsa | ncsa, (illinois|university|of)? ncsa open source LIC
w3c | w3c, w3c | w3c, w3c software (notice|and)? (and|document)? notice? LIC
vim | vim, vim | vim, vim LIC
qpl-1.0 | qpl, qpl 1 0 | q, q public LIC (version|v)? 1? 0?
sleepycat | sleepycat, sleepycat | sleepycat, sleepycat (public|software)? LIC
upl-1.0 | upl, upl 1 0 | permissive, universal permissive LIC (version|v)? 1? 0?
ecl-2.0 | ecl, ecl 2 0 | educational, educational community LIC (version|v)? 2? 0?
lppl-1.3c | lppl, lppl 1 3c | latex, latex project public LIC (version|v)? 1? 3c?
nasa-1.3 | nosa, nosa 1? 3? | nasa, nasa open source agreement (version|v)? 1? 3?
cecill-2.1 | cecill, cecill (2|v2) 1 | cecill, cecill free? software? LIC agreement? (version|v)? 2 1
cecill-b | cecill, cecill b | cecill, cecill b LIC
cecill-c | cecill, cecill c | cecill, cecill c LIC
blueoak-1.0.0 | blueoak, blueoak 1 0 0 | oak, blue oak model LIC (version|v)? 1? 0? 0?
mulanpsl-2.0 | mulanpsl, mulanpsl 2? 0? | mulan, mulan permissive software LIC (version|v)? (2|v2)?
json | json, json license | json, json LIC
icu | icu, icu | icu, icu LIC
unicode | unicode, unicode (dfs|tou|3) (2015|2016)? | unicode, unicode LIC (agreement|v3)?
tcl | tcl, tcl | tcl, tcl (tk)? LIC
zpl-2.1 | zpl, zpl 2 1 | zope, zope public LIC (version|v)? 2? 1?
hpnd | hpnd, hpnd | permission, historical permission notice and disclaimer
curl | curl, curl | curl, curl LIC
ijg | ijg, ijg | jpeg, independent jpeg group LIC
ftl | ftl, ftl | freetype, freetype (project)? LIC
bzip2-1.0.6 | bzip2, bzip2 1 0 6 | bzip2, bzip2 LIC
info-zip | info, info zip | zip, info zip LIC
watcom-1.0 | watcom, watcom 1 0 | watcom, sybase? open watcom public LIC (version|v)? 1? 0?
rpl-1.5 | rpl, rpl 1 5 | reciprocal, reciprocal public LIC (version|v)? 1? 5?
sgi-b-2.0 | sgi, sgi b 2 0 | sgi, sgi free software LIC b? (version|v)? 2? 0?
sissl | sissl, sissl | sun, sun industry standards source LIC
spl-1.0 | spl, spl 1 0 | sun, sun public LIC (version|v)? 1? 0?
lpl-1.02 | lpl, lpl 1 02 | lucent, lucent public LIC (version|v)? 1? 02?
fair | fair, fair | fair, fair LIC
miros | miros, miros | miros, miros LIC
naumen | naumen, naumen | naumen, naumen public LIC
motosoto | motosoto, motosoto | motosoto, motosoto open source LIC
nokia | nokia, nokia | nokia, nokia open source LIC
intel | intel, intel | intel, intel open source LIC
eudatagrid | eudatagrid, eudatagrid | datagrid, eu datagrid software LIC
polyform-noncommercial | polyform, polyform noncommercial 1? 0? 0? | polyform, polyform noncommercial LIC
polyform-small-business | polyform, polyform small business 1? 0? 0? | polyform, polyform small business LIC
openrail | openrail, (creativeml|bigscience|bigcode)? openrail m? | rail, (creativeml|bigscience|bigcode)? open rail m? LIC?
llama-community | llama, llama [0-9]+? [0-9]+? community | llama, llama [0-9]+? [0-9]+? community LIC agreement?
"""

#: label | keyword, name: families without a version.
_FAMILIES = """
apache | apache, apache software? LIC
gpl | general, gnu? general public LIC
gpl | gpl, gnu gpl
lgpl | general, (library|lesser) general public LIC
lgpl | lgpl, gnu? lgpl
agpl | affero, affero general public LIC
agpl | agpl, gnu? agpl
gfdl | documentation, free documentation LIC
bsd | bsd, bsd style? LIC
mpl | mozilla, mozilla public LIC
epl | eclipse, eclipse public LIC
cddl | common, common development and distribution LIC
cpl | common, common public LIC
eupl | union, european union public LIC
artistic | artistic, artistic LIC
afl | academic, academic free LIC
osl | open, open software LIC
apsl | apple, apple public source LIC
php | php, php LIC
psf | psf, psf LIC
cecill | cecill, cecill LIC
creative-commons | commons, creative commons LIC?
public-domain | domain, (in|into|to) the public domain
public-domain | domain, public domain (software|work|code|dedication)
proprietary | reserved, all rights reserved
proprietary | proprietary, proprietary and confidential
"""

#: label | keyword, sentence of a license's text or of its usual notice.
_SENTENCES = """
mit | granted, permission is hereby granted free of charge to any person obtaining a copy of this software
mit | substantial, the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | hereby, permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | hereby, permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
bsd | redistribution, redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions, redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions, redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause | endorse, neither the (name|names) of [a-z0-9]+ [a-z0-9]+? [a-z0-9]+? nor the names of its contributors may be used to endorse or promote
bsd-3-clause | endorse, may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising, all advertising materials mentioning features or use of this software must display the following (acknowledgement|acknowledgment)
apache-2.0 | apache, licensed under the apache LIC version 2 0 the LIC
apache-2.0 | compliance, you may not use this file except in compliance with the LIC
apache-2.0 | governing, see the LIC for the specific language governing permissions and limitations under the LIC
apache-2.0 | apache, (http|https) www apache org licenses LIC 2 0
gpl | redistribute, this program is free software you can redistribute it and or modify it under the terms of the gnu general public LIC
gpl | merchantability, without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public LIC
gpl | gnu, you should have received a copy of the gnu general public LIC
lgpl | redistribute, this library is free software you can redistribute it and or modify it under the terms of the gnu (library|lesser) general public LIC
lgpl | gnu, you should have received a copy of the gnu (library|lesser) general public LIC
agpl | gnu, you should have received a copy of the gnu affero general public LIC
agpl | affero, under the terms of the gnu affero general public LIC as published by the free software foundation
gpl | foundation, as published by the free software foundation either version [0-9]+ of the LIC
mpl-2.0 | mozilla, this source code form is subject to the terms of the mozilla public LIC v 2 0
mpl-1.1 | mozilla, the contents of this file are subject to the mozilla public LIC version 1 1
epl | eclipse, this program and the accompanying materials are made available under the terms of the eclipse public LIC
cddl | common, the contents of this file are subject to the terms of the common development and distribution LIC
unlicense | unencumbered, this is free and unencumbered software released into the public domain
wtfpl | fuck, you just do what the fuck you want to
zlib | provided, this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | misrepresented, the origin of this software must not be misrepresented
bsl-1.0 | boost, distributed under the boost software LIC version 1 0
ofl-1.1 | font, this font software is licensed under the sil open font LIC version 1 1
cc0-1.0 | waived, has waived all copyright and related or neighboring rights
beerware | beer, if we meet some day and you think this stuff is worth it you can buy me a beer
json | evil, the software shall be used for good not evil
postgresql | documentation, permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | disclaimers, redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
ms-pl | software, this LIC governs use of the accompanying software if you use the software you accept this LIC
artistic-2.0 | artistic, under the terms of the artistic LIC 2 0
openssl | openssl, this product includes software developed by the openssl project
x11 | consortium, except as contained in this notice the name of the x consortium shall not be used
proprietary | confidential, this (file|software|document) is confidential and proprietary
proprietary | written, without the (express|prior) prior? written (consent|permission) of
proprietary | unauthorized, unauthorized (copying|use|distribution) of this (file|software|document)
"""

_KINDS = {"by": "attribution", "by-sa": "attribution share-alike", "by-nc": "attribution non-commercial", "by-nd": "attribution no-derivatives", "by-nc-sa": "attribution non-commercial share-alike", "by-nc-nd": "attribution non-commercial no-derivatives"}
_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_UNDER = "(licen[cs]ed|released|distributed|available|published|provided|redistributed) under the? (terms|conditions)? (of|and)? (the|conditions)? gnu?"


def _row(line: str) -> tuple[str, list[tuple[str, str]]]:
    """label | keyword, pattern | ... with alternatives inside brackets."""
    out, depth, part = [], 0, ""
    for c in line:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    label, *rest = [*out, part.strip()]
    return label, [tuple(x.split(", ", 1)) for x in rest]


def _creative_commons() -> list[str]:
    lines = []
    for kind, name in _KINDS.items():
        words = name.replace("share-alike", "(share|sharealike) alike?").replace("non-commercial", "(non|noncommercial) commercial?").replace("no-derivatives", "(no|noderivatives|noderivs) (derivatives|derivs|derivative)?")
        for v in _VERSIONS:
            lines.append(f"cc-{kind}-{v} | cc, cc {' '.join(kind.split('-'))} {' '.join(v.split('.'))} | commons, creative commons {words} (works)? {' '.join(v.split('.'))}")
    return lines


def rules() -> list[Rule]:
    """All rules in order; of two that match the same words with the same priority, the earlier one counts."""
    out = [Rule(label, key, 0, p) for label, [(key, p)] in map(_row, _SENTENCES.strip().splitlines())]
    for label, ((id_key, identifier), (name_key, name)) in map(_row, [*_NAMES.strip().splitlines(), *_creative_commons()]):
        out += [
            Rule(label, "spdx", 0, f"spdx LIC identifier {identifier}"),
            Rule(label, name_key, 0, f"{_UNDER} {name}"),
            Rule(label, name_key, 1, name),
            Rule(label, id_key, 3, f"{identifier} licen[cs](e|ed|es|ing)"),
            Rule(label, id_key, 3, f"(LIC|licensed|copying) (under|is|s)? (the)? {identifier}"),
        ]
    out += [Rule(label, key, 2, p) for label, [(key, p)] in map(_row, _FAMILIES.strip().splitlines())]
    return out
