"""Hand-written license signatures of operator 8.

One signature a line: label; pattern.  Patterns are lower-case regular expressions on words: a blank stands for any
separators, punctuation and line breaks included, `` ?`` for separators that may be missing.  Optional words are groups
that carry their own blank.
"""

from __future__ import annotations

import re

#: Sentences of license bodies and of the notices that authors put into their files.
NOTICES = """
mit; permission is hereby granted free of charge to any person obtaining a copy
mit; permission is hereby granted free of charge
mit; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit; the software is provided as is without warranty of any kind express or implied
x11; except as contained in this notice the name of the x consortium shall not be used in advertising
isc; permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc; the software is provided as is and the author disclaims all warranties with regard to this software
hpnd; permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd; redistribution and use in source and binary forms with or without modification are permitted
bsd; redistribution and use in source and binary forms
bsd; redistributions of source code must retain the above copyright notice
bsd; redistributions in binary form must reproduce the above copyright notice
bsd; this software is provided by the copyright holders and contributors as is
bsd; use of this source code is governed by a bsd style licen[cs]e
bsd-3-clause; neither the names? of .{1,80} nor the names of its contributors may be used to endorse or promote products
bsd-3-clause; may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
gpl; this program is free software you can redistribute it
gpl; this (?:program |library |file |software )is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl; you should have received a copy of the gnu general public licen[cs]e along with this (?:program|software|file|library)
gpl-2.0; either version 2 of the licen[cs]e or at your option any later version
gpl-2.0; free software foundation inc 59 temple place
gpl-2.0; free software foundation inc 51 franklin st(?:reet)? fifth floor boston
gpl-3.0; either version 3 of the licen[cs]e or at your option any later version
gpl; this program is distributed in the hope that it will be useful but without any warranty
gpl; everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
gpl-1.0; the licen[cs]e agreements of most software companies try to keep users at the mercy of those companies
gpl-2.0; the licen[cs]es for most software are designed to take away your freedom to share and change it
gpl-3.0; the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
lgpl; this library is free software you can redistribute it
lgpl; you should have received a copy of the gnu lesser general public licen[cs]e
lgpl-2.0; you should have received a copy of the gnu library general public licen[cs]e
lgpl; a program that contains no derivative of any portion of the library but is designed to work with the library
agpl; you should have received a copy of the gnu affero general public licen[cs]e
agpl-3.0; your modified version must prominently offer all users interacting with it remotely through a computer network
gfdl; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl; with no invariant sections no front cover texts and no back cover texts
apache-2.0; you may not use this file except in compliance with the licen[cs]e
apache-2.0; you may obtain a copy of the licen[cs]e at http www apache org licenses license 2 0
apache-2.0; unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache-2.0; terms and conditions for use reproduction and distribution
apache; licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements
apache-1.1; this product includes software developed by the apache software foundation
mpl-2.0; this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0; if a copy of the mpl was not distributed with this file
mpl-1.1; the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl; alternatively the contents of this file may be used under the terms of either the gnu general public licen[cs]e
npl-1.1; the contents of this file are subject to the netscape public licen[cs]e
epl-1.0; this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v ?1(?: 0)?
epl-2.0; this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v? ?2(?: 0)?
epl; the accompanying program is provided under the terms of this eclipse public licen[cs]e
cpl-1.0; the accompanying program is provided under the terms of this common public licen[cs]e
cddl; the contents of this file are subject to the terms of the common development and distribution licen[cs]e
eupl; licensed under the eupl
osl-3.0; licensed under the open software licen[cs]e version 3 0
afl-3.0; licensed under the academic free licen[cs]e version 3 0
bsl-1.0; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
bsl-1.0; distributed under the boost software licen[cs]e
zlib; this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib; the origin of this software must not be misrepresented
zlib; altered source versions must be plainly marked as such
unlicense; this is free and unencumbered software released into the public domain
unlicense; anyone is free to copy modify publish use compile sell or distribute this software
wtfpl; do what the fuck you want to
public-domain; the author disclaims copyright to this source code
public-domain; placed in the public domain
public-domain; dedicate[sd]? (?:this work |the work )?to the public domain
public-domain; this work is not (?:subject to|protected by) copyright
cc0-1.0; to the extent possible under law .{1,120} waived all copyright and related or neighboring rights
cc0-1.0; the person who associated a work with this deed has dedicated the work to the public domain
cc-by; you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made
cc-by-sa; if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e
cc-by-nc; you may not use the material for commercial purposes
cc-by-nd; if you remix transform or build upon the material you may not distribute the modified material
cc; this work is licensed under a creative commons
cc; some rights reserved
cc; the work as defined below is provided under the terms of this creative commons public licen[cs]e
artistic; the intent of this document is to state the conditions under which a package may be copied
artistic-2.0; everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document the artistic
perl; this (?:program |library |module )is free software you can redistribute it and or modify it under the same terms as perl itself
python; psf is making python available to licensee on an as is basis
php; this product includes php software freely available from
ruby; you may make and give away verbatim copies of the source form of the software without restriction
openssl; this product includes software developed by the openssl project
curl; permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
ntp; permission to use copy modify and distribute this software and its documentation for any purpose with or without fee
ofl; this font software is licensed under the sil open font licen[cs]e
ofl; the font software may be sold as part of a larger software package
odbl; this (?:database |dataset )is made available under the open database licen[cs]e
ms-pl; if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e do not use the software
ncsa; developed by .{1,80} to deal with the software without restriction
json; the software shall be used for good not evil
beerware; as long as you retain this notice you can do whatever you want with this stuff
beerware; you can buy me a beer in return
commons-clause; the licen[cs]e does not include and the licen[cs]e does not grant to you the right to sell the software
elastic-2.0; you may not provide the software to third parties as a hosted or managed service
sspl-1.0; making the functionality of the program or modified version available to third parties as a service
busl-1.1; the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
proprietary; all rights reserved no part of this (?:publication|book|document|work) may be reproduced
proprietary; unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document) via any medium is strictly prohibited
proprietary; this software is (?:the )?(?:confidential and )?proprietary (?:information )?(?:of|and)
"""

#: Addresses of license texts.
ADDRESSES = """
gpl; gnu org licenses gpl
gpl-2.0; gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0; gnu org licenses gpl 3 0
gpl; gnu org copyleft gpl
lgpl; gnu org licenses lgpl
lgpl-2.1; gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0; gnu org licenses lgpl 3 0
agpl-3.0; gnu org licenses agpl(?: 3 0)?
gfdl; gnu org licenses fdl
apache-2.0; apache org licenses license 2 0
apache-1.1; apache org licenses license 1 1
mit; opensource org licenses? mit(?: license)?
bsd-2-clause; opensource org licenses? bsd 2 clause
bsd-3-clause; opensource org licenses? bsd 3 clause
bsd; opensource org licenses? bsd license
isc; opensource org licenses? isc
artistic-2.0; opensource org licenses? artistic(?: license)? 2 0
mpl-1.1; mozilla org mpl mpl 1 1
mpl-2.0; mozilla org (?:en us )?mpl 2 0
mpl; mozilla org mpl
epl-1.0; eclipse org legal epl v10
epl-2.0; eclipse org legal epl (?:v20|2 0)
bsl-1.0; boost org license 1 0
unlicense; unlicense org
wtfpl; wtfpl net
ofl; scripts sil org ofl
odbl; opendatacommons org licenses odbl
odc-by; opendatacommons org licenses by
pddl; opendatacommons org licenses pddl
cddl; opensource org licenses? cddl
php; php net license
python; python org (?:download releases .{1,12} )?license
cc-by-1.0; creativecommons org licenses by 1 0
cc-by-2.0; creativecommons org licenses by 2 0
cc-by-2.5; creativecommons org licenses by 2 5
cc-by-3.0; creativecommons org licenses by 3 0
cc-by-4.0; creativecommons org licenses by 4 0
cc-by-sa-2.0; creativecommons org licenses by sa 2 0
cc-by-sa-2.5; creativecommons org licenses by sa 2 5
cc-by-sa-3.0; creativecommons org licenses by sa 3 0
cc-by-sa-4.0; creativecommons org licenses by sa 4 0
cc-by-nc-2.0; creativecommons org licenses by nc 2 0
cc-by-nc-3.0; creativecommons org licenses by nc 3 0
cc-by-nc-4.0; creativecommons org licenses by nc 4 0
cc-by-nd-3.0; creativecommons org licenses by nd 3 0
cc-by-nd-4.0; creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0; creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0; creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0; creativecommons org licenses by nc nd 4 0
cc0-1.0; creativecommons org publicdomain zero 1 0
public-domain; creativecommons org publicdomain mark 1 0
"""

#: Short names, acronyms and spellings of versions.
SHORT_NAMES = """
gpl; gnu gpl
gpl; gpl licen[cs]ed?
gpl-1.0; (?:gnu )?gpl (?:version |v )?v?1(?: 0)?
gpl-2.0; (?:gnu )?gpl (?:version |v )?v?2(?: 0)?
gpl-3.0; (?:gnu )?gpl (?:version |v )?v?3(?: 0)?
gpl-2.0; gplv2
gpl-3.0; gplv3
gpl; gnu public licen[cs]e
gpl; gnu copyleft
lgpl; lgpl
lgpl-2.1; lgpl (?:version |v )?v?2 1
lgpl-2.1; lgplv2 1
lgpl-3.0; lgpl (?:version |v )?v?3(?: 0)?
lgpl-3.0; lgplv3
lgpl; (?:gnu )?lesser general public licen[cs]e
agpl; agpl
agpl-3.0; agpl (?:version |v )?v?3(?: 0)?
agpl-3.0; agplv3
agpl; affero gpl
gfdl; gfdl
gfdl; gnu fdl
apache-2.0; apache (?:licen[cs]e )?(?:version |v )?v?2 0
apache-2.0; apache licen[cs]e v2(?: 0)?
apache-2.0; apache 2 licen[cs]e
apache-1.0; apache licen[cs]e (?:version |v )?v?1 0
apache-1.1; apache licen[cs]e (?:version |v )?v?1 1
asl-2.0; asl (?:version |v )?v?2(?: 0)?
mit; mit licensed
mit; mit style licen[cs]e
mit; expat licen[cs]e
mit; mit x11 licen[cs]e
bsd; bsd licen[cs]ed?
bsd; bsd style licen[cs]e
bsd; berkeley software distribution licen[cs]e
bsd-2-clause; freebsd licen[cs]e
bsd-2-clause; two clause bsd
bsd-3-clause; three clause bsd
bsd-3-clause; revised bsd
bsd-4-clause; four clause bsd
bsd-3-clause-clear; clear bsd licen[cs]e
mpl; mpl licensed
mpl-1.1; mpl (?:version |v )?v?1 1
mpl-2.0; mpl (?:version |v )?v?2 0
mpl; mozilla public licen[cs]e
epl; eclipse public licen[cs]e
epl-1.0; epl (?:version |v )?v?1 0
epl-2.0; epl (?:version |v )?v?2 0
cpl-1.0; common public licen[cs]e
ipl-1.0; ibm public licen[cs]e
eupl; eupl
cddl; cddl
cecill; cecill(?: licen[cs]e)?
osl; open software licen[cs]e
afl; academic free licen[cs]e
apsl; apple public source licen[cs]e
qpl; q public licen[cs]e
npl; netscape public licen[cs]e
spl; sun public licen[cs]e
lppl; latex project public licen[cs]e
artistic; perl artistic licen[cs]e
zpl; zope public licen[cs]e
w3c; w3c software (?:notice and )?licen[cs]e
postgresql; postgresql licen[cs]e
php; php licen[cs]e
ruby; ruby licen[cs]e
openssl; openssl licen[cs]e
vim; vim licen[cs]e
ncsa; university of illinois ncsa open source licen[cs]e
upl-1.0; universal permissive licen[cs]e
ms-pl; microsoft public licen[cs]e
ms-rl; microsoft reciprocal licen[cs]e
sspl-1.0; server side public licen[cs]e
busl-1.1; business source licen[cs]e
elastic-2.0; elastic licen[cs]e
commons-clause; commons clause
json; json licen[cs]e
beerware; beerware licen[cs]e
beerware; beer ware licen[cs]e
libpng; libpng licen[cs]e
ijg; independent jpeg group
freetype; freetype licen[cs]e
hpnd; historical permission notice and disclaimer
mulan-psl; mulan permissive software licen[cs]e
blueoak-1.0; blue oak model licen[cs]e
ogl; open government licen[cs]e
etalab; etalab open licen[cs]e
odc-by; open data commons attribution licen[cs]e
pddl; public domain dedication and licen[cs]e
cdla; community data licen[cs]e agreement
cc-by-sa; creative commons attribution share ?alike
cc-by-nc; creative commons attribution non ?commercial
cc-by-nd; creative commons attribution no ?deriv(?:ative)?s
cc-by-nc-sa; creative commons attribution non ?commercial share ?alike
cc-by-nc-nd; creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-sa; cc by sa
cc-by-nc; cc by nc
cc-by-nd; cc by nd
cc-by-nc-sa; cc by nc sa
cc-by-nc-nd; cc by nc nd
cc0-1.0; creative commons zero
bigscience-rail; bigscience (?:open )?rail
openrail; openrail(?: m)?
llama-community; llama .{1,8} community licen[cs]e
"""

#: (priority, signatures).
SIGNATURES = [
    (priority, *[part.strip() for part in line.split(";", 1)])
    for priority, block in ((90, NOTICES), (85, ADDRESSES), (50, SHORT_NAMES)) for line in block.strip().splitlines()
]

#: Identifiers that stand behind an SPDX tag; the label is the identifier in lower case without its suffix.
SPDX = """
0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CPL-1.0 curl ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ISC JSON LGPL-2.0
LGPL-2.1 LGPL-3.0 LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL
PSF-2.0 Ruby SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()

_INNERMOST = re.compile(r"\(\?:([^()]*)\)\??")


def mandatory_words(pattern: str, most: int = 3) -> list[str]:
    """The longest whole words that every match of ``pattern`` contains: what is left beside groups and character choices.

    A group that brings its own blank on one side leaves whole words around it; any other group or choice makes
    the word it touches unknown, which only weakens the filter.
    """
    def kept(m):
        branches = m[1].split("|")
        own_blank = all(b[-1:] == " " for b in branches) or all(b[:1] == " " for b in branches)
        return "" if own_blank else "\0"

    while True:
        pattern, n = _INNERMOST.subn(kept, pattern)
        if not n:
            break
    words = {w for w in pattern.replace(" ?", "\0").split(" ") if re.fullmatch(r"[a-z0-9]+", w)}
    return sorted(words, key=lambda w: (-len(w), w))[:most]
