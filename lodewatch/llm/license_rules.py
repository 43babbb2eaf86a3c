"""Signatures of licenses, written over words: lower case, one space between two words.

A line is `label priority pattern`. In a pattern, `@` stands before the rule's anchor, the rare
word that brings the rule up (`@a/b`: either word); `(?:the )?` is a word that may be missing, and
`<3>` stands for up to three words of any kind. Priority 3 is a tag, an address or the wording of a
license itself, 2 names a license as a license, 1 only mentions one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The most words a signature may have before its anchor, and from its anchor on.
BEFORE, AFTER = 16, 32

#: The labels and phrases that always count: (label, pattern). No other rule suppresses them.
BASE = [
    ("mit", "under the mit @license"),
    ("apache-2", "@apache license version 2"),
    ("cc-by-nc", "@cc by nc"),
]

SIGNATURES = r"""
mit 3 @spdx license identifier mit(?: [a-z]+)?
mit 3 opensource org licen[cs]es? @mit
mit 3 permission is @hereby granted free of charge to any person obtaining a copy
mit 3 without restriction including without limitation the rights to use copy modify merge publish distribute @sublicense
mit 3 the above copyright notice and this permission notice shall be included in all copies or @substantial portions
mit 2 the mit @license/licence
mit 2 (?:licensed|released|distributed|available) (?:under|by) (?:the )?(?:terms of )?(?:the )?mit(?: x11)? @license/licence
mit 2 mit @licensed
mit 1 @license/licence mit
mit 2 mit style @license/licence
mit 2 (?:expat|x11) @license/licence
mit-0 3 @spdx license identifier mit 0
mit-0 2 mit no @attribution(?: license)?
apache-2 3 @spdx license identifier apache 2 0
apache-2 3 @apache org licenses license 2 0
apache-2 3 licensed under the @apache license version 2 0 the license
apache-2 3 you may not use this file except in @compliance with the license
apache-2 2 @apache license (?:v|version )?2(?: 0)?
apache-2 2 @apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?
apache-2 2 @apache 2 0(?: licen[cs]ed?)?
apache-2 2 @apache2(?: 0)? licen[cs]e
apache-2 2 @asl 2 0
apache-2 1 @apache 2
apache-1 3 @spdx license identifier apache 1 [01]
apache-1 2 @apache (?:software )?license (?:v|version )?1 [01]
apache 1 @apache (?:software )?licen[cs]e
gpl-3 3 @spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 3 gnu org licen[cs]es @gpl 3 0
gpl-3 3 @gnu general public license as published by the free software foundation (?:either )?version 3
gpl-3 3 gnu general public license <4> version 3 <12> free software @foundation
gpl-3 2 @gnu general public licen[cs]e (?:v|version )?3(?: 0)?(?: or (?:any )?later)?
gpl-3 2 @gpl (?:v|version )?3(?: 0)?(?: only| or (?:any )?later)?
gpl-3 2 @gplv3(?: or (?:any )?later)?
gpl-2 3 @spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 3 gnu org licen[cs]es (?:old licenses )?@gpl 2 0
gpl-2 3 @gnu general public license as published by the free software foundation (?:either )?version 2
gpl-2 2 @gnu general public licen[cs]e (?:v|version )?2(?: 0)?(?: or (?:any )?later)?
gpl-2 2 @gpl (?:v|version )?2(?: 0)?(?: only| or (?:any )?later)?
gpl-2 2 @gplv2(?: or (?:any )?later)?
gpl-2-classpath 3 @spdx license identifier gpl 2 0(?: only)? with classpath exception 2 0
gpl-2-classpath 2 gpl <6> with (?:the )?@classpath exception
gpl-1 3 @spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 2 @gnu general public licen[cs]e (?:v|version )1(?: 0)?
gpl 3 you should have received a copy of the @gnu general public license along with this
gpl 3 this program is free software you can @redistribute it and or modify it under the terms of the gnu general public license
gpl 2 @gnu general public licen[cs]e
gpl 2 @gnu gpl
gpl 2 @gpl licen[cs]ed?
gpl 2 @gpled
lgpl-3 3 @spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 3 gnu org licen[cs]es @lgpl 3 0
lgpl-3 2 @gnu lesser general public licen[cs]e (?:v|version )?3(?: 0)?
lgpl-3 2 @lgpl (?:v|version )?3(?: 0)?
lgpl-3 2 @lgplv3
lgpl-2-1 3 @spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2-1 3 gnu org licen[cs]es (?:old licenses )?@lgpl 2 1
lgpl-2-1 2 @gnu lesser general public licen[cs]e (?:v|version )?2 1
lgpl-2-1 2 @lgpl (?:v|version )?2 1
lgpl-2-1 2 @lgplv2 1
lgpl-2 3 @spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 2 @gnu library general public licen[cs]e(?: (?:v|version )?2(?: 0)?)?
lgpl 2 @gnu lesser general public licen[cs]e
lgpl 2 gnu @lgpl
lgpl 2 @lgpl licen[cs]ed?
agpl-3 3 @spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 3 gnu org licen[cs]es @agpl 3 0
agpl-3 2 gnu @affero general public licen[cs]e (?:v|version )?3(?: 0)?
agpl-3 2 @agpl (?:v|version )?3(?: 0)?
agpl-3 2 @agplv3
agpl 2 (?:gnu )?@affero general public licen[cs]e
agpl 2 @agpl licen[cs]ed?
gfdl 3 @spdx license identifier gfdl 1 [123](?: [a-z]+){0,4}
gfdl 2 @gnu free documentation licen[cs]e(?: version 1 [123])?
gfdl 2 @gfdl(?: (?:v|version )?1 [123])?
sspl-1 3 @spdx license identifier sspl 1 0
sspl-1 2 server side public @license/licence(?: version 1)?
bsd-2 3 @spdx license identifier bsd 2 clause
bsd-2 3 opensource org licenses @bsd 2 clause
bsd-2 2 (?:simplified|2 clause|two clause|freebsd) @bsd(?: licen[cs]e)?
bsd-2 2 @bsd 2 clause(?: licen[cs]e)?
bsd-2 2 @freebsd licen[cs]e
bsd-3 3 @spdx license identifier bsd 3 clause
bsd-3 3 opensource org licenses @bsd 3 clause
bsd-3 3 neither the name of <12> nor the names of its contributors may be used to @endorse or promote products
bsd-3 2 (?:new|revised|modified|3 clause|three clause) @bsd(?: licen[cs]e)?
bsd-3 2 @bsd 3 clause(?: licen[cs]e)?
bsd-4 3 @spdx license identifier bsd 4 clause
bsd-4 3 all @advertising materials mentioning features or use of this software must display the following
bsd-4 2 (?:original|4 clause|four clause) @bsd(?: licen[cs]e)?
bsd-0 3 @spdx license identifier 0bsd
bsd-0 2 (?:zero clause|0 clause) @bsd(?: licen[cs]e)?
bsd-0 2 @0bsd
bsd 3 @redistributions of source code must retain the above copyright notice
bsd 3 @redistributions in binary form must reproduce the above copyright notice
bsd 3 redistribution and use in source and binary forms with or without modification are @permitted
bsd 2 @bsd (?:style )?licen[cs]ed?
isc 3 @spdx license identifier isc
isc 3 permission to use copy modify and or distribute this software for any purpose with or without @fee is hereby granted
isc 2 @isc licen[cs]ed?
mpl-2 3 @spdx license identifier mpl 2 0
mpl-2 3 @mozilla org mpl 2 0
mpl-2 3 subject to the terms of the @mozilla public license (?:v|version )?2 0
mpl-2 2 @mozilla public licen[cs]e (?:v|version )?2(?: 0)?
mpl-2 2 @mpl (?:v|version )?2 0
mpl-1-1 3 @spdx license identifier mpl 1 1
mpl-1-1 2 @mozilla public licen[cs]e (?:v|version )?1 1
mpl-1-1 2 @mpl (?:v|version )?1 1
mpl 2 @mozilla public licen[cs]e
epl-2 3 @spdx license identifier epl 2 0
epl-2 3 @eclipse org legal epl (?:v )?2 0
epl-2 2 @eclipse public licen[cs]e (?:v|version )?2(?: 0)?
epl-2 2 @epl (?:v|version )?2(?: 0)?
epl-1 3 @spdx license identifier epl 1 0
epl-1 3 @eclipse org legal epl v10
epl-1 2 @eclipse public licen[cs]e (?:v|version )?1(?: 0)?
epl 2 @eclipse public licen[cs]e
edl-1 2 @eclipse distribution licen[cs]e(?: (?:v|version )?1(?: 0)?)?
cpl-1 3 @spdx license identifier cpl 1 0
cpl-1 2 common public @license/licence(?: (?:v|version )?1(?: 0)?)?
ipl-1 2 ibm public @license/licence(?: (?:v|version )?1(?: 0)?)?
cddl-1 3 @spdx license identifier cddl 1 [01]
cddl-1 2 common development and distribution @license/licence(?: (?:v|version )?1(?: [01])?)?
cddl-1 2 @cddl(?: (?:v|version )?1 [01])?(?: licen[cs]e)?
eupl-1-2 3 @spdx license identifier eupl 1 2
eupl-1-2 2 european union public @license/licence(?: (?:v|version )?1 2)
eupl 2 european union public @license/licence
eupl 2 @eupl(?: (?:v|version )?1 [012])?
artistic-2 3 @spdx license identifier artistic 2 0
artistic-2 2 @artistic licen[cs]e (?:v|version )?2(?: 0)?
artistic-1 3 @spdx license identifier artistic 1 0(?: [a-z0-9]+)?
artistic 2 (?:perl )?@artistic licen[cs]e
boost-1 3 @spdx license identifier bsl 1 0
boost-1 3 @boost org license 1 0(?: txt)?
boost-1 3 permission is @hereby granted free of charge to any person or organization obtaining a copy
boost-1 2 @boost software licen[cs]e(?: (?:v|version )?1(?: 0)?)?
busl-1-1 3 @spdx license identifier busl 1 1
busl-1-1 2 business source @license/licence(?: (?:v|version )?1 1)?
zlib 3 @spdx license identifier zlib
zlib 3 this software is provided as is without any express or implied @warranty in no event will the authors be held liable
zlib 3 altered source versions must be plainly marked as such and must not be @misrepresented
zlib 2 @zlib(?: libpng)? licen[cs]e
libpng 3 @spdx license identifier libpng(?: 2 0)?
libpng 2 @libpng licen[cs]e
unlicense 3 @spdx license identifier unlicense
unlicense 3 @unlicense org
unlicense 3 this is free and @unencumbered software released into the public domain
unlicense 2 (?:under )?the @unlicense
cc0-1 3 @spdx license identifier cc0 1 0
cc0-1 3 @creativecommons org publicdomain zero 1 0
cc0-1 2 @creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
cc0-1 2 @cc0(?: (?:v|version )?1 0)?(?: universal)?
cc-pdm 3 @creativecommons org publicdomain mark 1 0
cc-pdm 2 public domain @mark(?: 1 0)
cc-by 3 @spdx license identifier cc by [1-4] [05]
cc-by 3 @creativecommons org licenses by [1-4] [05]
cc-by 2 @creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by 2 @cc by(?: [1-4] [05])
cc-by 2 @cc by(?: licen[cs]e)
cc-by-sa 3 @spdx license identifier cc by sa [1-4] [05]
cc-by-sa 3 @creativecommons org licenses by sa [1-4] [05]
cc-by-sa 2 @creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa 2 @cc by sa(?: [1-4] [05])?
cc-by-nd 3 @spdx license identifier cc by nd [1-4] [05]
cc-by-nd 3 @creativecommons org licenses by nd [1-4] [05]
cc-by-nd 2 @creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nd 2 @cc by nd(?: [1-4] [05])?
cc-by-nc 3 @spdx license identifier cc by nc [1-4] [05]
cc-by-nc 3 @creativecommons org licenses by nc [1-4] [05]
cc-by-nc 2 @creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc 2 @cc by nc(?: [1-4] [05])?
cc-by-nc-sa 3 @spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-sa 3 @creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa 2 @creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc-sa 2 @cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd 3 @spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-nd 3 @creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd 2 @creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc-nd 2 @cc by nc nd(?: [1-4] [05])?
cc 1 @creative commons licen[cs]e
odbl-1 3 @spdx license identifier odbl 1 0
odbl-1 3 @opendatacommons org licenses odbl
odbl-1 2 open (?:data commons open )?database @license/licence
odc-by-1 3 @spdx license identifier odc by 1 0
odc-by-1 3 @opendatacommons org licenses by
odc-by-1 2 open data commons @attribution(?: licen[cs]e)?
pddl-1 3 @spdx license identifier pddl 1 0
pddl-1 3 @opendatacommons org licenses pddl
pddl-1 2 public domain dedication and @license/licence
cdla-permissive 3 @spdx license identifier cdla permissive [12] 0
cdla-permissive 2 community data license agreement @permissive
cdla-sharing 3 @spdx license identifier cdla sharing 1 0
cdla-sharing 2 community data license @agreement sharing
ogl-uk 3 @spdx license identifier ogl uk [123] 0
ogl-uk 2 open government @license/licence(?: v?[123](?: 0)?)?
public-domain 2 (?:released|dedicated|placed|put) (?:in|into|to) the public @domain
public-domain 1 (?:is|are) in the public @domain
wtfpl 3 @spdx license identifier wtfpl
wtfpl 2 do what the fuck you want to public @license/licence
wtfpl 2 @wtfpl
python-2 3 @spdx license identifier (?:psf|python) 2 0
python-2 2 @python software foundation licen[cs]e(?: (?:v|version )?2(?: 0)?)?
python-2 2 @psf licen[cs]e(?: agreement)?
ruby 3 @spdx license identifier ruby
ruby 2 @ruby licen[cs]e
php-3 3 @spdx license identifier php 3 0(?:1)?
php-3 2 @php licen[cs]e(?: (?:v|version )?3(?: 01?)?)?
postgresql 3 @spdx license identifier postgresql
postgresql 2 @postgresql licen[cs]e
openssl 3 @spdx license identifier openssl
openssl 2 @openssl(?: ssleay)? licen[cs]e
curl 3 @spdx license identifier curl
curl 2 @curl licen[cs]e
ncsa 3 @spdx license identifier ncsa
ncsa 2 university of illinois ncsa open source @license/licence
ncsa 2 @ncsa(?: open source)? licen[cs]e
w3c 3 @spdx license identifier w3c(?: [0-9]+)?
w3c 2 @w3c software (?:notice and )?(?:document )?licen[cs]e
vim 3 @spdx license identifier vim
vim 2 @vim licen[cs]e
tcl 3 @spdx license identifier tcl
tcl 2 @tcl tk licen[cs]e
ftl 3 @spdx license identifier ftl
ftl 2 @freetype (?:project )?licen[cs]e
ijg 2 independent jpeg group (?:s )?@license/licence
icu 3 @spdx license identifier icu
icu 2 @icu licen[cs]e
unicode 3 @spdx license identifier unicode (?:dfs (?:2015|2016)|3 0|tou)
unicode 2 @unicode (?:inc )?(?:license|terms of use)
ofl-1-1 3 @spdx license identifier ofl 1 1
ofl-1-1 3 scripts @sil org ofl
ofl-1-1 2 @sil open font licen[cs]e(?: (?:v|version )?1 [01])?
ofl 1 open font @license/licence
afl-3 3 @spdx license identifier afl [23] [01]
afl-3 2 academic free @license/licence(?: (?:v|version )?[23](?: [01])?)?
osl-3 3 @spdx license identifier osl [123] [01]
osl-3 2 open software @license/licence(?: (?:v|version )?[123](?: [01])?)?
ms-pl 3 @spdx license identifier ms pl
ms-pl 2 @microsoft public licen[cs]e
ms-rl 3 @spdx license identifier ms rl
ms-rl 2 @microsoft reciprocal licen[cs]e
cecill-2 3 @spdx license identifier cecill 2 [01]
cecill 2 @cecill(?: [bc])?(?: (?:v|version )?[12](?: [01])?)?(?: licen[cs]e)?
mulan-2 3 @spdx license identifier mulanpsl 2 0
mulan-2 2 @mulan permissive software licen[cs]e(?: (?:v|version )?2)?
elastic-2 3 @spdx license identifier elastic 2 0
elastic-2 2 @elastic licen[cs]e(?: (?:v|version )?2(?: 0)?)
polyform 3 @spdx license identifier polyform (?:noncommercial|small business) 1 0 0
polyform 2 @polyform (?:noncommercial|shield|strict|perimeter|free trial|small business|internal use)(?: licen[cs]e)?
commons-clause 3 the software is provided to you by the licensor under the license <4> subject to the following @condition
commons-clause 2 commons @clause (?:licen[cs]e )?condition
openrail-m 2 (?:creativeml |bigscience )?open @rail(?: m)?
openrail-m 2 (?:creativeml |bigscience )?@openrail(?: m)?(?: licen[cs]e)?
blueoak-1 3 @spdx license identifier blueoak 1 0 0
blueoak-1 2 @blue oak model licen[cs]e(?: 1 0 0)?
upl-1 3 @spdx license identifier upl 1 0
upl-1 2 universal permissive @license/licence(?: (?:v|version )?1(?: 0)?)?
beerware 3 @spdx license identifier beerware
beerware 2 the beer ?ware @license/licence
jquery 2 @jquery licen[cs]e
json 3 the software shall be used for good not @evil
sleepycat 3 @spdx license identifier sleepycat
sleepycat 2 @sleepycat licen[cs]e
watcom 2 @sybase open watcom public licen[cs]e
nasa 2 @nasa open source agreement
qpl-1 3 @spdx license identifier qpl 1 0
qpl-1 2 (?:trolltech )?q public @license/licence
lppl 3 @spdx license identifier lppl 1 [0-3][a-c]?
lppl 2 @latex project public licen[cs]e(?: (?:v|version )?1 [0-3][a-c]?)?
zpl-2 3 @spdx license identifier zpl 2 [01]
zpl-2 2 @zope public licen[cs]e(?: (?:v|version )?2(?: [01])?)?
all-rights-reserved 1 @copyright <8> all rights reserved
proprietary 1 proprietary and @confidential
no-warranty 1 without even the implied warranty of @merchantability or fitness for a particular purpose
"""


@dataclass(frozen=True)
class Rule:
    """pattern: over ' ' + words + ' ', with '@' before the anchor; need: what the window must hold, too."""

    number: int
    label: str
    priority: int
    base: bool
    anchor: str
    need: tuple[str, ...]
    pattern: str


def outside_groups(pattern: str) -> str:
    """The pattern with # for its gaps, groups and classes and for single letters that may be missing."""
    pattern = re.sub(r"<\d+>", "#", pattern)
    while (cut := re.sub(r"\((?:[^()])*\)(?:[?*+]|\{[^}]*\})?", "#", pattern)) != pattern:
        pattern = cut
    return re.sub(r"(?:\[[^]]*\]|.)(?:[?*+]|\{[^}]*\})|\[[^]]*\]", "#", pattern)


def rules(signatures: str = SIGNATURES, base: list[tuple[str, str]] = BASE) -> list[Rule]:
    """All rules, base phrases first; an anchor of two spellings gives two rules."""
    lines = [(label, 4, True, pattern) for label, pattern in base]
    for line in signatures.strip().splitlines():
        label, priority, pattern = line.split(" ", 2)
        lines.append((label, int(priority), False, pattern))
    found: list[Rule] = []
    for label, priority, fixed, pattern in lines:
        anchors = re.search(r"@([a-z0-9/]+)", pattern)[1]
        for anchor in anchors.split("/"):
            one = pattern.replace("@" + anchors, "@" + anchor)
            words = sorted({w for w in re.findall(r"(?<![^ ])[a-z0-9]+(?![^ ])", outside_groups(one).replace("@" + anchor, "#"))}, key=len)
            regex = " " + re.sub(r"<(\d+)>", r"(?:[^ ]+ ){0,\1}?", one).replace("}? ", "}?") + " "
            found.append(Rule(len(found), label, priority, fixed, anchor, tuple(f" {w} " for w in words[-2:]), regex))
    return found
