"""Signature rules for licence scans: patterns over the words of a text.

A pattern reads lower-case words with one space between them. Its first word is fixed, so
that the places where a rule can match are those of its keyword. Patterns have no repetition
of unbounded length.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    #: Keywords: the words a match can start with.
    anchors: tuple[str, ...]
    #: A word that stands in every match.
    key: str
    pattern: str
    label: str
    #: Of two matches of which one contains the other, the higher level stays.
    level: int
    score: float
    base: bool = False


#: phrase -> label of the places every scan reports
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

MENTION, GRANT, TEXT, TAG = 2, 3, 4, 5
LEVELS = 5
SCORES = {1: 0.5, MENTION: 0.7, GRANT: 0.9, TEXT: 0.95, TAG: 1.0}

LICENSE = "licen[sc]e"
V = "( version| v)?"
#: label | SPDX words | name, a star where the name alone is no licence
NAMES = f"""
mit | mit | mit( expat| x11)? *
mit-0 | mit 0 | mit no attribution
expat | expat | expat *
x11 | x11 | x11 *
isc | isc | isc *
bsd-2-clause | bsd 2 clause | bsd (2|two) clause
bsd-3-clause | bsd 3 clause | bsd (3|three) clause
bsd-4-clause | bsd 4 clause | bsd (4|four) clause
bsd-2-clause | freebsd | freebsd *
bsd-2-clause | bsd 2 clause | simplified bsd
bsd-3-clause | bsd 3 clause | (new|modified|revised) bsd
bsd-4-clause | bsd 4 clause | original bsd
0bsd | 0bsd | zero clause bsd
bsd | bsd | bsd *
bsd | bsd | berkeley software distribution *
apache-1.0 | apache 1 0 | apache( software)?( {LICENSE})?{V} 1 0
apache-1.1 | apache 1 1 | apache( software)?( {LICENSE})?{V} 1 1
apache-2.0 | apache 2 0 | apache( software)?( {LICENSE})?{V} (2 0|2|v2 0|v2)
apache | apache | apache( software)? *
asl-2.0 | asl 2 0 | asl{V} 2 0
gpl-1.0 | gpl 1 0 | gnu general public {LICENSE}{V} 1( 0)?
gpl-2.0 | gpl 2 0 | gnu general public {LICENSE}{V} 2( 0)?
gpl-3.0 | gpl 3 0 | gnu general public {LICENSE}{V} 3( 0)?
gpl | gpl | gnu general public
gpl-2.0 | gpl 2 0 only | gnu gpl{V} 2( 0)?
gpl-3.0 | gpl 3 0 only | gnu gpl{V} 3( 0)?
gpl | gpl 3 0 or later | gnu gpl
gpl-2.0 | gpl 2 0 or later | gpl{V} 2( 0)?
gpl-3.0 | gpl 3 0 | gpl{V} 3( 0)?
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gplv3 | gplv3
gpl | gpl | gpl *
lgpl-2.0 | lgpl 2 0 | gnu (library|lesser) general public {LICENSE}{V} 2( 0)?
lgpl-2.1 | lgpl 2 1 | gnu (library|lesser) general public {LICENSE}{V} 2 1
lgpl-3.0 | lgpl 3 0 | gnu (library|lesser) general public {LICENSE}{V} 3( 0)?
lgpl | lgpl | gnu (library|lesser) general public
lgpl-2.1 | lgpl 2 1 or later | lgpl{V} 2 1
lgpl-3.0 | lgpl 3 0 or later | lgpl{V} 3( 0)?
lgpl-2.1 | lgplv2 1 | lgplv2 1
lgpl-3.0 | lgplv3 | lgplv3
lgpl | lgpl 2 1 only | lgpl *
agpl-3.0 | agpl 3 0 | gnu affero general public {LICENSE}{V} 3( 0)?
agpl | agpl 3 0 only | gnu affero general public
agpl | agpl 3 0 or later | affero general public
agpl-3.0 | agplv3 | agpl{V} 3( 0)?
agpl | agpl 1 0 | agpl *
gfdl-1.2 | gfdl 1 2 | gnu free documentation {LICENSE}{V} 1 2
gfdl-1.3 | gfdl 1 3 | gnu free documentation {LICENSE}{V} 1 3
gfdl | gfdl | gnu free documentation
gfdl | gfdl 1 1 | gfdl
mpl-1.0 | mpl 1 0 | mozilla public {LICENSE}{V} 1 0
mpl-1.1 | mpl 1 1 | mozilla public {LICENSE}{V} 1 1
mpl-2.0 | mpl 2 0 | mozilla public {LICENSE}{V} 2( 0)?
mpl | mpl | mozilla public
mpl-2.0 | mpl 2 0 no copyleft exception | mpl{V} 2 0
npl-1.1 | npl 1 1 | netscape public
epl-1.0 | epl 1 0 | eclipse public {LICENSE}{V} 1( 0)?
epl-2.0 | epl 2 0 | eclipse public {LICENSE}{V} 2( 0)?
epl | epl | eclipse public
cpl-1.0 | cpl 1 0 | common public *
cddl-1.0 | cddl 1 0 | common development and distribution {LICENSE}{V} 1 0
cddl-1.1 | cddl 1 1 | common development and distribution {LICENSE}{V} 1 1
cddl | cddl | common development and distribution
eupl-1.1 | eupl 1 1 | european union public {LICENSE}{V} 1 1
eupl-1.2 | eupl 1 2 | european union public {LICENSE}{V} 1 2
eupl | eupl | european union public
artistic-1.0 | artistic 1 0 | artistic {LICENSE}{V} 1( 0)?
artistic-2.0 | artistic 2 0 | artistic {LICENSE}{V} 2( 0)?
artistic | artistic | artistic *
bsl-1.0 | bsl 1 0 | boost software *
busl-1.1 | busl 1 1 | business source *
zlib | zlib | zlib( libpng)? *
libpng | libpng | libpng *
psf-2.0 | psf 2 0 | python software foundation *
python-2.0 | python 2 0 | python {LICENSE}{V} 2( 0)?
php-3.01 | php 3 01 | php {LICENSE}{V} 3 01
php | php 3 0 | php *
ruby | ruby | ruby *
openssl | openssl | openssl *
postgresql | postgresql | postgresql *
unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl
ofl-1.1 | ofl 1 1 | sil open font *
ms-pl | ms pl | microsoft public *
ms-rl | ms rl | microsoft reciprocal *
osl-3.0 | osl 3 0 | open software {LICENSE}{V} 3( 0)?
afl-3.0 | afl 3 0 | academic free *
upl-1.0 | upl 1 0 | universal permissive *
ncsa | ncsa | ncsa( open source)? *
sspl-1.0 | sspl 1 0 | server side public *
elastic-2.0 | elastic 2 0 | elastic {LICENSE}{V} 2( 0)?
blueoak-1.0.0 | blueoak 1 0 0 | blue oak model *
odbl-1.0 | odbl 1 0 | open database *
odc-by-1.0 | odc by 1 0 | open data commons attribution *
pddl-1.0 | pddl 1 0 | public domain dedication and *
openrail | openrail | openrail( m)? *
cc0-1.0 | cc0 1 0 | cc0( 1 0)?
cc-by-nc-nd | cc by nc nd 4 0 | cc by nc nd
cc-by-nc-sa | cc by nc sa 4 0 | cc by nc sa
cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
cc-by-nc | cc by nc 3 0 | cc by nc
cc-by-nd | cc by nd 4 0 | cc by nd
cc-by-sa-3.0 | cc by sa 3 0 | cc by sa 3 0
cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
cc-by-sa | cc by sa 2 5 | cc by sa
cc-by-3.0 | cc by 3 0 | cc by 3 0
cc-by-4.0 | cc by 4 0 | cc by 4 0
cc-by | cc by 2 0 | cc by
cc-by-nc-nd | cc by nc nd 3 0 | creative commons attribution non ?commercial no ?deriv(ative|ative work|ative works|atives|s)?
cc-by-nc-sa | cc by nc sa 3 0 | creative commons attribution non ?commercial share ?alike
cc-by-nc | cc by nc 2 0 | creative commons attribution non ?commercial
cc-by-nd | cc by nd 3 0 | creative commons attribution no ?deriv(ative|ative work|ative works|atives|s)?
cc-by-sa | cc by sa 2 0 | creative commons attribution share ?alike
cc-by | cc by 2 5 | creative commons attribution
cc0-1.0 | cc0 | creative commons zero
cc | cc pddc | creative commons *
"""

#: label | wording of the licence itself
TEXTS = f"""
mit | permission is hereby granted free of charge to any person obtaining a copy
mit | software is provided as is without warranty of any kind express or implied
isc | permission to use copy modify and( or)? distribute this software for any purpose with or without fee
0bsd | purpose with or without fee is hereby granted
bsd | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | neither the name of the copyright holder nor the names of its contributors
bsd-4-clause | advertising materials mentioning features or use of this software must display
apache-2.0 | except in compliance with the {LICENSE}
apache-2.0 | perpetual worldwide non exclusive no charge royalty free irrevocable copyright {LICENSE}
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the {LICENSE}
gpl | redistribute it and or modify it under the terms of the gnu general public {LICENSE}
gpl-2.0 | redistribute it and or modify it under the terms of the gnu general public {LICENSE}( as published by the free software foundation)?( either)?( version)? 2
gpl-3.0 | redistribute it and or modify it under the terms of the gnu general public {LICENSE}( as published by the free software foundation)?( either)?( version)? 3
lgpl | redistribute it and or modify it under the terms of the gnu (lesser|library) general public {LICENSE}
agpl | redistribute it and or modify it under the terms of the gnu affero general public {LICENSE}
gpl | everyone is permitted to copy and distribute verbatim copies of this {LICENSE} document
mpl | subject to the terms of the mozilla public {LICENSE}
epl | accompanying materials are made available under the terms of the eclipse public {LICENSE}
zlib | altered source versions must be plainly marked as such
zlib | misrepresented you must not claim that you wrote the original software
bsl-1.0 | boost software {LICENSE} version 1 0
unlicense | unencumbered software released into the public domain
wtfpl | fuck you want to public {LICENSE}
public-domain | released into the public domain
public-domain | dedicated to the public domain
public-domain | placed in the public domain
public-domain | public domain dedication
cc0-1.0 | waived all copyright and related or neighboring rights
ofl-1.1 | font software is licensed under the sil open font {LICENSE}
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {LICENSE}
all-rights-reserved | rights reserved
proprietary | proprietary and confidential
proprietary | confidential and proprietary
proprietary | unauthorized copying of this (file|software|work)
non-commercial | non commercial use only
non-commercial | noncommercial use only
dual | dual licensed
copyleft | copyleft {LICENSE}
"""

VERBS = ("licensed", "released", "distributed", "available", "provided", "covered", "published", "redistributed")
UNDER = "under( the)?( terms of)?( the)?( conditions of)?( the)?"


def _entries(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split("|", table is NAMES and 2 or 1)] for line in table.strip().splitlines()]


def _starts(pattern: str) -> tuple[str, ...]:
    """The words a pattern can start with: a word or a group of words in brackets."""
    if pattern.startswith("("):
        return tuple(pattern[1 : pattern.index(")")].split("|"))
    return (pattern.split(" ")[0].split("(")[0],)


def build_rules() -> list[Rule]:
    """All rules: base phrases, names alone, granted, as an SPDX tag, and licence texts."""
    rules = [Rule((p.split()[0],), p.split()[0], p, label, 1, SCORES[1], True) for p, label in BASE.items()]

    def add(anchors, key, pattern, label, level):
        rules.append(Rule(anchors, key, pattern, label, level, SCORES[level]))

    for label, spdx, name in _entries(NAMES):
        needs = name.endswith("*")
        name = name.rstrip("* ")
        starts = _starts(name)
        key = starts[0] if len(starts) == 1 else name[name.index(")") + 1 :].split()[0]
        alone = f"{name} {LICENSE}" if needs else f"{name}( {LICENSE})?"
        add(starts, key, alone, label, MENTION)
        add(VERBS, key, f"({'|'.join(VERBS)}) {UNDER} {name}( {LICENSE})?", label, GRANT)
        add(("spdx",), spdx.split()[0], f"spdx {LICENSE} identifier {spdx}", label, TAG)
    for label, text in _entries(TEXTS):
        add(_starts(text), _starts(text)[0], text, label, TEXT)
    return rules


RULES = build_rules()
#: No match has more words: each is cut at the spaces of its pattern.
WIDTH = 1 + max(r.pattern.count(" ") for r in RULES)
