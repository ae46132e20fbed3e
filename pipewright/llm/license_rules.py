"""Signature rules of the license scan (operator 4).

FIXED VALUES, written by hand. A line is ``label priority keyword: pattern``. A pattern is a row of
words; each is a regular expression for one lower-case word of a text, with ``?`` at its end the word
may be missing, and ``@n`` stands for up to n words of any kind. The keyword is a string that every
match holds; texts without it are not searched for the rule. Rules for SPDX tags follow from SPDX_IDS.
"""

NOTICES = """
apache-2.0 90 apache: apache license version? 2 0?
apache-2.0 90 apache: apache license v2 0?
apache-2.0 92 apache: licensed under the? apache license version 2 0
apache-2.0 95 apache: you may not use this file except in compliance with the license @12 apache
apache-2.0 85 apache: apache software license version? 2 0?
apache-2.0 85 apache: apache 2 0 (license|licence)
apache-1.1 90 apache: apache software license version? 1 1
apache-1.0 88 apache: apache license version? 1 0
apache 50 apache: apache (license|licence)
apache 55 apache: licensed under the? apache (license|licence)
mit 90 permission: permission is hereby granted free of charge to any person obtaining a copy of this software
mit 85 mit: (released|licensed|distributed|available) under the? (terms)? of? the? mit (license|licence)
mit 80 mit: the mit (license|licence)
mit 70 mit: mit (license|licence)
mit 65 mit: mit licensed
mit 60 mit: license mit
mit-0 92 mit: mit no attribution (license)?
x11 75 x11: x11 (license|licence)
isc 90 permission: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc 75 isc: isc (license|licence)
bsd-4-clause 92 advertising: all advertising materials mentioning features or use of this software must display
bsd-4-clause 85 bsd: (4|four) clause bsd (license|licence)?
bsd-4-clause 80 bsd: original bsd (license|licence)
bsd-3-clause 92 endorse: neither the (name|names) of @12 nor the names of its contributors may be used to endorse or promote products
bsd-3-clause 85 bsd: (3|three) clause bsd (license|licence)?
bsd-3-clause 85 bsd: bsd (3|three) clause (license|licence)?
bsd-3-clause 82 bsd: (new|modified|revised) bsd (license|licence)
bsd-2-clause 85 bsd: (2|two) clause bsd (license|licence)?
bsd-2-clause 85 bsd: bsd (2|two) clause (license|licence)?
bsd-2-clause 82 bsd: simplified bsd (license|licence)
bsd-2-clause 82 freebsd: freebsd (license|licence)
0bsd 85 bsd: zero clause bsd (license|licence)?
bsd 70 redistribution: redistribution and use in source and binary forms with or without modification are permitted
bsd 50 bsd: bsd style? (license|licence)
bsd 55 bsd: (released|licensed|distributed) under the? bsd (license|licence)
gpl-1.0 85 gnu: gnu general public (license|licence) version 1
gpl-2.0 85 gnu: gnu general public (license|licence) version 2
gpl-2.0 85 gnu: gnu gpl version? v?2
gpl-2.0 80 gpl: gpl (version|v)? v?2 0?
gpl-2.0 80 gplv2: gplv2
gpl-2.0-or-later 92 later: version 2 of the license or at your option any later version
gpl-2.0-or-later 90 gnu: gnu general public (license|licence) version 2 or later
gpl-2.0-or-later 88 gpl: gpl (version|v)? v?2 0? or later
gpl-2.0-only 90 gnu: gnu general public (license|licence) version 2 only
gpl-3.0 85 gnu: gnu general public (license|licence) version 3
gpl-3.0 86 gnu: licensed under the? gnu general public (license|licence) version 3
gpl-3.0 85 gnu: gnu gpl version? v?3
gpl-3.0 80 gpl: gpl (version|v)? v?3 0?
gpl-3.0 80 gplv3: gplv3
gpl-3.0-or-later 92 later: version 3 of the license or at your option any later version
gpl-3.0-or-later 90 gnu: gnu general public (license|licence) version 3 or later
gpl-3.0-or-later 88 gpl: gpl (version|v)? v?3 0? or later
gpl-3.0-only 90 gnu: gnu general public (license|licence) version 3 only
gpl 50 gnu: gnu general public (license|licence)
gpl 45 general: general public (license|licence)
gpl 45 gnu: gnu gpl
gpl 60 gnu: this program is free software you can redistribute it and or modify it under the terms of the gnu general public (license|licence)
lgpl-2.0 86 gnu: gnu library general public (license|licence) version 2
lgpl-2.1 86 gnu: gnu lesser general public (license|licence) version 2 1
lgpl-2.1 82 lgpl: lgpl (version|v)? v?2 1
lgpl-2.1-or-later 93 gnu: gnu lesser general public (license|licence) @8 version 2 1 of the license or at your option any later version
lgpl-3.0 86 gnu: gnu lesser general public (license|licence) version 3
lgpl-3.0 82 lgpl: lgpl (version|v)? v?3 0?
lgpl-3.0 82 lgplv3: lgplv3
lgpl 60 gnu: gnu lesser general public (license|licence)
lgpl 58 gnu: gnu library general public (license|licence)
agpl-3.0 87 affero: gnu affero general public (license|licence) version 3
agpl-3.0 82 agpl: agpl (version|v)? v?3 0?
agpl-3.0 82 agplv3: agplv3
agpl-3.0-or-later 93 affero: gnu affero general public (license|licence) @8 version 3 of the license or at your option any later version
agpl 62 affero: gnu? affero general public (license|licence)
gfdl-1.1 85 documentation: gnu free documentation (license|licence) version 1 1
gfdl-1.2 85 documentation: gnu free documentation (license|licence) version 1 2
gfdl-1.3 85 documentation: gnu free documentation (license|licence) version 1 3
gfdl 60 documentation: gnu? free documentation (license|licence)
mpl-1.0 85 mozilla: mozilla public (license|licence) version? v? 1 0
mpl-1.1 85 mozilla: mozilla public (license|licence) version? v? 1 1
mpl-2.0 85 mozilla: mozilla public (license|licence) version? v? 2 0
mpl-2.0 92 mozilla: this source code form is subject to the terms of the mozilla public (license|licence) v? 2 0
mpl-2.0 80 mpl: mpl (version|v)? 2 0
mpl 55 mozilla: mozilla public (license|licence)
epl-1.0 85 eclipse: eclipse public (license|licence) version? v? v?1 0
epl-2.0 85 eclipse: eclipse public (license|licence) version? v? v?2 0
epl 55 eclipse: eclipse public (license|licence)
edl-1.0 80 eclipse: eclipse distribution (license|licence) version? v? 1 0
cddl-1.0 85 distribution: common development and distribution (license|licence) version? 1 0
cddl-1.1 85 distribution: common development and distribution (license|licence) version? 1 1
cddl 60 distribution: common development and distribution (license|licence)
cpl-1.0 75 common: common public (license|licence) version? v? 1 0
ipl-1.0 75 ibm: ibm public (license|licence) version? 1 0
eupl-1.1 85 european: european union public (license|licence) version? v? 1 1
eupl-1.2 85 european: european union public (license|licence) version? v? 1 2
eupl 60 european: european union public (license|licence)
artistic-1.0 80 artistic: artistic (license|licence) version? 1 0
artistic-2.0 85 artistic: artistic (license|licence) version? 2 0
artistic 55 artistic: artistic (license|licence)
perl 70 perl: (same|under the same) terms as perl itself
boost-1.0 85 boost: boost software (license|licence) version? 1 0
boost-1.0 70 boost: boost software (license|licence)
zlib 75 zlib: zlib libpng? (license|licence)
zlib 90 origin: the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng 75 libpng: libpng (license|licence)
unlicense 90 unencumbered: this is free and unencumbered software released into the public domain
unlicense 75 unlicense: the unlicense
unlicense 70 unlicense: unlicense org
wtfpl 80 public: do what the fuck you want to public (license|licence)
wtfpl 75 wtfpl: wtfpl
postgresql 75 postgresql: postgresql (license|licence)
openssl 75 openssl: openssl (license|licence)
ssleay 75 ssleay: ssleay (license|licence)
openldap-2.8 75 openldap: openldap public (license|licence) version? 2 8
php-3.01 80 php: php (license|licence) version? 3 01
php 60 php: php (license|licence)
python-2.0 80 python: python software foundation (license|licence) version? 2?
ruby 65 ruby: ruby (license|licence)
ofl-1.1 85 font: sil open font (license|licence) version? 1 1
ofl 65 font: (sil)? open font (license|licence)
odbl-1.0 82 database: open database (license|licence) version? v? 1? 0?
odc-by 82 data: open data commons attribution (license|licence)
pddl-1.0 82 domain: public domain dedication and (license|licence)
ms-pl 80 microsoft: microsoft public (license|licence)
ms-rl 80 microsoft: microsoft reciprocal (license|licence)
apsl-2.0 80 apple: apple public source (license|licence) version? 2 0
osl-3.0 82 open: open software (license|licence) version? v? 3 0
afl-3.0 82 academic: academic free (license|licence) version? v? 3 0
qpl-1.0 75 public: q public (license|licence)
sleepycat 75 sleepycat: sleepycat (license|licence)
sspl-1.0 82 server: server side public (license|licence)
bsl-1.1 82 business: business source (license|licence) version? 1? 1?
elastic-2.0 80 elastic: elastic (license|licence) version? 2? 0?
commons-clause 80 commons: commons clause (license|licence)? condition?
json 80 evil: the software shall be used for good not evil
beerware 80 beer: beer ware (license|licence)
vim 65 vim: vim (license|licence)
ncsa 78 ncsa: university of illinois ncsa open source (license|licence)
ecl-2.0 80 educational: educational community (license|licence) version? 2? 0?
upl-1.0 80 universal: universal permissive (license|licence) version? 1? 0?
cecill-2.1 80 cecill: cecill (free)? (software)? (license|licence)? (agreement)? version? 2 1
cecill 60 cecill: cecill
hpnd 75 historical: historical permission notice and disclaimer
w3c 75 w3c: w3c software (notice)? (and)? (license|licence)
unicode 75 unicode: unicode (license|licence) (agreement)?
cc0-1.0 88 cc0: cc0 1 0 (universal)?
cc0-1.0 75 cc0: cc0
cc0-1.0 85 creative: creative commons zero @2 (universal)?
cc-by-1.0 82 cc: cc by 1 0
cc-by-2.0 82 cc: cc by 2 0
cc-by-2.5 82 cc: cc by 2 5
cc-by-3.0 82 cc: cc by 3 0
cc-by-4.0 82 cc: cc by 4 0
cc-by-sa-2.0 86 cc: cc by sa 2 0
cc-by-sa-2.5 86 cc: cc by sa 2 5
cc-by-sa-3.0 86 cc: cc by sa 3 0
cc-by-sa-4.0 86 cc: cc by sa 4 0
cc-by-sa 70 cc: cc by sa
cc-by-nc-2.0 86 cc: cc by nc 2 0
cc-by-nc-3.0 86 cc: cc by nc 3 0
cc-by-nc-4.0 86 cc: cc by nc 4 0
cc-by-nc 70 cc: cc by nc
cc-by-nd-3.0 86 cc: cc by nd 3 0
cc-by-nd-4.0 86 cc: cc by nd 4 0
cc-by-nd 70 cc: cc by nd
cc-by-nc-sa-3.0 90 cc: cc by nc sa 3 0
cc-by-nc-sa-4.0 90 cc: cc by nc sa 4 0
cc-by-nc-sa 75 cc: cc by nc sa
cc-by-nc-nd-3.0 90 cc: cc by nc nd 3 0
cc-by-nc-nd-4.0 90 cc: cc by nc nd 4 0
cc-by-nc-nd 75 cc: cc by nc nd
cc-by-nc 83 licensed: licensed under cc by nc
cc-by-sa 83 licensed: licensed under cc by sa
cc-by-4.0 84 creative: creative commons attribution 4 0 international? (license|licence)?
cc-by-3.0 84 creative: creative commons attribution 3 0 unported? (license|licence)?
cc-by-sa-4.0 88 creative: creative commons attribution (sharealike|share) alike? 4 0 international? (license|licence)?
cc-by-sa-3.0 88 creative: creative commons attribution (sharealike|share) alike? 3 0 unported? (license|licence)?
cc-by-sa 74 creative: creative commons attribution (sharealike|share) alike?
cc-by-nc 74 creative: creative commons attribution (noncommercial|non) commercial?
cc-by-nc-4.0 88 creative: creative commons attribution (noncommercial|non) commercial? 4 0 international?
cc-by-nd 74 creative: creative commons attribution (noderivatives|no) derivatives?
cc-by-nc-sa-4.0 92 creative: creative commons attribution (noncommercial|non) commercial? (sharealike|share) alike? 4 0 international?
cc-by-nc-nd-4.0 92 creative: creative commons attribution (noncommercial|non) commercial? (noderivatives|no) derivatives? 4 0 international?
cc 50 creative: creative commons (license|licence)
cc 55 creativecommons: creativecommons org licenses
public-domain 75 domain: (released|dedicated|placed) (in|into|to) the public domain
public-domain 60 domain: this @3 is in the public domain
proprietary 80 proprietary: proprietary and confidential
proprietary 70 unauthorized: unauthorized (copying|reproduction|distribution) @8 is (strictly)? prohibited
proprietary 60 permission: (may|must) not be (reproduced|copied|distributed) @10 without @6 permission
reserved 50 reserved: all rights reserved
reserved 55 reserved: copyright @10 all rights reserved
reserved 40 droits: tous droits réservés
reserved 40 rechte: alle rechte vorbehalten
reserved 40 derechos: todos los derechos reservados
copyright 30 copyright: copyright (c)? (19|20)[0-9][0-9]
copyright 25 copyright: copyright notice
free-license 20 licen: (released|licensed|distributed|available|published) under (the|a|an)? @3 (license|licence)
"""

SPDX_IDS = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0
BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0
ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND IPL-1.0 ISC LGPL-2.0 LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng MIT MIT-0 MPL-1.1
MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL Python-2.0
QPL-1.0 Ruby Sleepycat SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib
"""


def _regex(pattern: str) -> str:
    """The regular expression of a pattern over a text whose every word stands between two spaces of its own."""
    out = []
    for word in pattern.split():
        if word[0] == "@":
            out.append(f"(?: [^ ]+ ){{0,{word[1:]}}}?")
        elif word[-1] == "?":
            out.append(f"(?: {word[:-1]} )?")
        else:
            out.append(f" {word} ")
    return "".join(out).replace("(", "(?:").replace("(?:?:", "(?:")


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regular expression) of all rules, in order."""
    out = []
    for line in NOTICES.strip().splitlines():
        head, _, pattern = line.partition(": ")
        label, priority, keyword = head.split()
        out.append((label, int(priority), keyword, _regex(pattern)))
    for name in SPDX_IDS.split():
        words = "".join(c if c.isalnum() else " " for c in name.lower())
        out.append((name.lower(), 98, "spdx", _regex("spdx license identifier " + words)))
    return out


RULES = rules()
_ROOTS = ("licen", " copyright ", " spdx ", " rights ", " gpl ", " public ", " permission ", " creative ", " cc ")


def _needs(pattern: str, root: str) -> bool:
    """Whether every match of a pattern holds a root: all spellings of some word that can't be missing do."""
    fixed = [w for w in pattern.split() if w[-1] != "?" and w[0] != "@"]
    return any(all(root in f" {spelling} " for spelling in w.strip("()").split("|")) for w in fixed)


def _roots() -> list[str]:
    out = list(_ROOTS)
    for head, _, pattern in (line.partition(": ") for line in NOTICES.strip().splitlines()):
        if not any(_needs(pattern, r) for r in out):
            keyword = head.split()[2]
            out.append(f" {keyword} " if _needs(pattern, f" {keyword} ") else keyword)
    return out


#: Every rule's matches hold one of these; a text without any is not looked at further.
ROOTS = _roots()
