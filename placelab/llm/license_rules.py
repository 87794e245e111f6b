"""Signature rules for licence statements, in order.

A heading names the label, its priority (1 is the strongest) and how sure a
match is. A rule is its keywords, a colon, and a pattern over words: lower-case
words without punctuation, one blank between two. `` .. `` stands for up to six words. All keywords have to occur in a text before the
pattern is tried. Of two equal stretches the earlier rule of the better
priority stands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases that are always counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

RULES_TEXT = r"""
[mit 1 0.99]
permission granted charge: permission is hereby granted free of charge to any person obtaining a copy
substantial portions: shall be included in all copies or substantial portions of the software
sell copies: publish distribute sublicense and or sell copies of the software
[mit 2 0.95]
spdx mit: spdx license identifier mit
opensource mit: opensource org licenses? mit(?: license)?
mit: (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit licen[cs]e
mit: (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit
mit expat: mit expat licen[cs]e
[mit 3 0.8]
mit: (?:the )?mit licen[cs]e(?: mit)?
expat: expat licen[cs]e
mit: licen[cs]e mit
mit: mit (?:style|like) licen[cs]e
[mit-0 2 0.95]
attribution mit: mit no attribution(?: licen[cs]e)?
spdx mit: spdx license identifier mit 0
[x11 3 0.8]
x11: (?:mit )?x11 licen[cs]e
consortium: x consortium licen[cs]e
[apache-2.0 1 0.99]
apache compliance: you may not use this file except in compliance with the license .. apache
apache compliance: licensed under the apache license version 2 0 .. compliance with the license
basis conditions: distributed on an as is basis without warranties or conditions of any kind
[apache-2.0 2 0.95]
spdx apache: spdx license identifier apache 2 0
apache: (?:the )?apache licen[cs]e (?:version |v ?)?2(?: 0)?
apache: (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?apache licen[cs]e(?: version)? 2 0
apache: apache org licenses license 2 0(?: txt| html)?
opensource apache: opensource org licenses apache 2 0
apache: apache (?:software )?licen[cs]e 2(?: 0)?
apache: asl 2 0 .. apache
[apache-2.0 3 0.85]
apache: apache 2(?: 0)?(?: licen[cs]ed?)?
apachev2: apachev2
apache: apache v2(?: 0)?
[apache-1.1 2 0.95]
apache: apache (?:software )?licen[cs]e (?:version )?1 1
spdx apache: spdx license identifier apache 1 1
apache foundation: includes software developed by the apache software foundation
[apache-1.0 2 0.95]
apache: apache (?:software )?licen[cs]e (?:version )?1 0
[apache 4 0.6]
apache: (?:the )?apache (?:software )?licen[cs]e
[bsd-3-clause 1 0.99]
neither endorse: neither the names? of .. nor the names of its contributors may be used to endorse
endorse promote: may (?:not )?be used to endorse or promote products derived from this software
[bsd-3-clause 2 0.95]
spdx bsd: spdx license identifier bsd 3 clause(?: clear| lbnl)?
opensource bsd: opensource org licenses bsd 3 clause
bsd: bsd 3 clause(?: licen[cs]e)?
bsd: (?:3|three) clause bsd(?: style)?(?: licen[cs]e)?
bsd: (?:new|modified|revised) bsd(?: licen[cs]e)?
[bsd-2-clause 1 0.98]
redistributions binary: redistributions in binary form must reproduce the above copyright notice
redistributions source: redistributions of source code must retain the above copyright notice
redistribution binary: redistribution and use in source and binary forms with or without modification are permitted
[bsd-2-clause 2 0.95]
spdx bsd: spdx license identifier bsd 2 clause(?: patent| views)?
opensource bsd: opensource org licenses bsd 2 clause
bsd: bsd 2 clause(?: licen[cs]e)?
bsd: (?:2|two) clause bsd(?: licen[cs]e)?
bsd: (?:simplified|freebsd) bsd(?: licen[cs]e)?
freebsd: freebsd licen[cs]e
[bsd-4-clause 2 0.95]
advertising mentioning: all advertising materials mentioning features or use of this software
spdx bsd: spdx license identifier bsd 4 clause(?: uc)?
bsd: (?:original|old|4 clause|four clause) bsd(?: licen[cs]e)?
[bsd 4 0.6]
bsd: (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of the )?bsd(?: style| type)? licen[cs]e
bsd: (?:the )?bsd(?: style| type)? licen[cs]e
0bsd: 0bsd
bsd clause: zero clause bsd(?: licen[cs]e)?
[gpl-3.0 1 0.99]
gnu redistribute: you can redistribute it and or modify it under the terms of the gnu general public license .. version 3
gnu: licensed under the gnu general public license (?:gpl )?version 3(?: 0)?
[gpl-3.0 2 0.95]
spdx gpl: spdx license identifier gpl 3 0(?: only| or later)?
gnu: gnu general public licen[cs]e(?: gpl)? (?:version |v ?)?3(?: 0)?(?: or later)?
gnu: gnu gpl (?:version |v ?)?3(?: 0)?(?: or later)?
gpl: gpl (?:version |v )?3(?: 0)?(?: only| or later)?
gplv3: gplv3
gnu: gnu org licenses gpl 3 0(?: html| txt)?
[gpl-2.0 1 0.99]
gnu redistribute: you can redistribute it and or modify it under the terms of the gnu general public license .. version 2
gnu: licensed under the gnu general public license (?:gpl )?version 2(?: 0)?
[gpl-2.0 2 0.95]
spdx gpl: spdx license identifier gpl 2 0(?: only| or later)?
gnu: gnu general public licen[cs]e(?: gpl)? (?:version |v ?)?2(?: 0)?(?: or later)?
gnu: gnu gpl (?:version |v ?)?2(?: 0)?(?: or later)?
gpl: gpl (?:version |v )?2(?: 0)?(?: only| or later)?
gplv2: gplv2
gnu: gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
[gpl 3 0.85]
gnu received: you should have received a copy of the gnu general public licen[cs]e
gnu: gnu general public licen[cs]e
gnu: gnu gpl
gplv1: gplv1
gpl: (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gpl
gpl: gpl licen[cs]ed?
gpl: gpl compatible
gnu: gnu org licenses gpl(?: html)?
[gpl-exception 2 0.95]
classpath exception: classpath exception
gcc exception: gcc runtime library exception
linking exception: (?:as a )?special exception .. linking
[lgpl-3.0 2 0.95]
spdx lgpl: spdx license identifier lgpl 3 0(?: only| or later)?
lesser: (?:gnu )?lesser general public licen[cs]e(?: lgpl)? (?:version |v ?)?3(?: 0)?
lgpl: lgpl (?:version |v )?3(?: 0)?(?: only| or later)?
lgplv3: lgplv3
[lgpl-2.1 2 0.95]
spdx lgpl: spdx license identifier lgpl 2 1(?: only| or later)?
lesser: (?:gnu )?lesser general public licen[cs]e(?: lgpl)? (?:version |v ?)?2 1
lgpl: lgpl (?:version |v )?2 1(?: only| or later)?
[lgpl-2.0 2 0.95]
library: (?:gnu )?library general public licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
spdx lgpl: spdx license identifier lgpl 2 0(?: only| or later)?
[lgpl 3 0.85]
lesser: (?:gnu )?lesser general public licen[cs]e
lgpl: (?:gnu )?lgpl
[agpl-3.0 2 0.95]
spdx agpl: spdx license identifier agpl 3 0(?: only| or later)?
affero: (?:gnu )?affero general public licen[cs]e(?: agpl)? (?:version |v ?)?3(?: 0)?
agpl: agpl (?:version |v )?3(?: 0)?(?: only| or later)?
agplv3: agplv3
[agpl 3 0.85]
affero: (?:gnu )?affero general public licen[cs]e
agpl: (?:gnu )?agpl
[gfdl 2 0.95]
spdx gfdl: spdx license identifier gfdl 1 [123](?: only| or later)?
gnu documentation: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation
documentation: (?:gnu )?free documentation licen[cs]e(?: version 1 [123])?
gfdl: gfdl
[mpl-2.0 1 0.98]
mozilla subject: this source code form is subject to the terms of the mozilla public licen[cs]e
[mpl-2.0 2 0.95]
spdx mpl: spdx license identifier mpl 2 0
mozilla: mozilla public licen[cs]e(?: mpl)? (?:version |v ?)?2(?: 0)?
mpl: mpl (?:version |v )?2(?: 0)?
mozilla: mozilla org mpl 2 0
[mpl-1.1 2 0.95]
mozilla: mozilla public licen[cs]e(?: mpl)? (?:version |v ?)?1 1
spdx mpl: spdx license identifier mpl 1 1
[mpl 3 0.8]
mozilla: mozilla public licen[cs]e
[epl-2.0 2 0.95]
spdx epl: spdx license identifier epl 2 0
eclipse: eclipse public licen[cs]e(?: epl)? (?:version |v ?)?2(?: 0)?
[epl-1.0 2 0.95]
spdx epl: spdx license identifier epl 1 0
eclipse: eclipse public licen[cs]e(?: epl)? (?:version |v ?)?1(?: 0)?
[epl 3 0.8]
eclipse: eclipse public licen[cs]e
eclipse: eclipse distribution licen[cs]e(?: v ?1 0)?
[cddl 2 0.9]
spdx cddl: spdx license identifier cddl 1 [01]
distribution: common development and distribution licen[cs]e(?: (?:version |v ?)?1 [01])?
cddl: cddl(?: 1 [01])?
[cpl 3 0.85]
common: common public licen[cs]e(?: (?:version |v ?)?1 0)?
ibm: ibm public licen[cs]e(?: (?:version |v ?)?1 0)?
[cc-by-nc-nd 2 0.97]
cc nc nd: cc by nc nd(?: [1234] [05])?(?: international| unported)?
attribution noncommercial: attribution noncommercial no ?deriv(?:s|ative|atives)(?: works)?(?: [1234] [05])?
attribution commercial: attribution non commercial no ?deriv(?:s|ative|atives)(?: works)?(?: [1234] [05])?
creativecommons nd: creativecommons org licenses by nc nd(?: [1234] [05])?
[cc-by-nc-sa 2 0.97]
cc nc sa: cc by nc sa(?: [1234] [05])?(?: international| unported)?
attribution noncommercial: attribution noncommercial share ?alike(?: [1234] [05])?
attribution commercial: attribution non commercial share ?alike(?: [1234] [05])?
creativecommons sa: creativecommons org licenses by nc sa(?: [1234] [05])?
[cc-by-nc 2 0.97]
cc nc: cc by nc(?: [1234] [05])?(?: international| unported)?
cc nc: licensed under (?:a |the )?cc by nc(?: [1234] [05])?
attribution noncommercial: (?:creative commons )?attribution noncommercial(?: [1234] [05])?
attribution commercial: (?:creative commons )?attribution non commercial(?: [1234] [05])?
creativecommons nc: creativecommons org licenses by nc(?: [1234] [05])?
[cc-by-sa 2 0.97]
cc sa: cc by sa(?: [1234] [05])?(?: international| unported)?
attribution sharealike: (?:creative commons )?attribution sharealike(?: [1234] [05])?
attribution alike: (?:creative commons )?attribution share alike(?: [1234] [05])?
creativecommons sa: creativecommons org licenses by sa(?: [1234] [05])?
[cc-by-nd 2 0.97]
cc nd: cc by nd(?: [1234] [05])?(?: international| unported)?
attribution noderivs: (?:creative commons )?attribution noderivs(?: [1234] [05])?
attribution no: (?:creative commons )?attribution no ?deriv(?:s|ative|atives)(?: [1234] [05])?
creativecommons nd: creativecommons org licenses by nd(?: [1234] [05])?
[cc-by-4.0 2 0.95]
cc 4: cc by 4 0(?: international)?
attribution 4: (?:creative commons )?attribution 4 0(?: international)?
creativecommons 4: creativecommons org licenses by 4 0
spdx cc: spdx license identifier cc by 4 0
[cc-by-3.0 2 0.95]
cc 3: cc by 3 0(?: unported)?
creativecommons 3: creativecommons org licenses by 3 0
creative 3: creative commons attribution 3 0
[cc-by-2.0 2 0.95]
cc 2: cc by 2 [05]
creativecommons 2: creativecommons org licenses by 2 [05]
[cc0 2 0.97]
cc0: cc0(?: 1 0)?(?: universal)?
spdx cc0: spdx license identifier cc0 1 0
creativecommons zero: creativecommons org publicdomain zero 1 0
commons zero: creative commons zero(?: v1 0)?(?: universal)?
[public-domain 2 0.9]
creativecommons mark: creativecommons org publicdomain mark 1 0
domain dedicated: (?:hereby )?dedicated .. to the public domain
domain released: released (?:in)?to the public domain
domain placed: placed in the public domain
domain mark: public domain mark(?: 1 0)?
domain dedication: public domain dedication
pddl: pddl(?: 1 0)?
[public-domain 4 0.5]
domain: (?:is |are )?in the public domain
[creative-commons 4 0.7]
creative commons: (?:a |the )?creative commons licen[cs]e
creative commons: creative commons attribution
creativecommons: creativecommons org
some reserved: some rights reserved
[odbl 2 0.95]
odbl: odbl(?: 1 0)?
database open: open (?:data commons )?(?:open )?database licen[cs]e
commons attribution: open data commons attribution licen[cs]e
odc: odc by(?: 1 0)?
[open-government 2 0.95]
government: open government licen[cs]e(?: v ?[123](?: 0)?)?
ogl: ogl uk(?: [123] 0)?
[cdla 2 0.95]
cdla: cdla (?:permissive|sharing) [12] 0
community data: community data licen[cs]e agreement
[unlicense 1 0.98]
unencumbered: this is free and unencumbered software released into the public domain
[unlicense 2 0.95]
unlicense: (?:the )?unlicense
unlicense: unlicense org
[wtfpl 2 0.95]
wtfpl: wtfpl
fuck: do what the fuck you want to public licen[cs]e
[isc 1 0.97]
permission fee: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
permission fee: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
[isc 2 0.92]
isc: (?:the )?isc licen[cs]e
spdx isc: spdx license identifier isc
[zlib 1 0.97]
origin misrepresented: the origin of this software must not be misrepresented
altered source: altered source versions must be plainly marked
[zlib 2 0.92]
zlib: (?:the )?zlib(?: libpng)? licen[cs]e
spdx zlib: spdx license identifier zlib
libpng: libpng licen[cs]e(?: 2 0)?
[bsl-1.0 2 0.95]
boost: boost software licen[cs]e(?: (?:version |v ?)?1 0)?
boost: boost org license 1 0(?: txt)?
spdx bsl: spdx license identifier bsl 1 0
[artistic-2.0 2 0.92]
artistic: artistic licen[cs]e (?:version |v ?)?2(?: 0)?
spdx artistic: spdx license identifier artistic 2 0
[artistic 3 0.8]
artistic: (?:the )?(?:perl )?artistic licen[cs]e
perl terms: same terms as perl(?: itself)?
[psf-2.0 2 0.92]
python foundation: python software foundation licen[cs]e(?: version 2)?
psf: psf licen[cs]e(?: agreement)?
spdx python: spdx license identifier python 2 0
[php-3.01 2 0.92]
php: (?:the )?php licen[cs]e(?: (?:version |v ?)?3 0[01]?)?
[openssl 2 0.92]
openssl: openssl licen[cs]e
openssl project: developed by the openssl project
ssleay: (?:original )?ssleay licen[cs]e
[postgresql 2 0.92]
postgresql: postgresql licen[cs]e
[ncsa 2 0.92]
illinois: university of illinois(?: ncsa)? open source licen[cs]e
ncsa: ncsa open source licen[cs]e
[upl 2 0.92]
universal permissive: universal permissive licen[cs]e(?: v ?1 0)?
[ms-pl 2 0.92]
microsoft: microsoft public licen[cs]e
ms: ms pl
[ms-rl 2 0.92]
microsoft reciprocal: microsoft reciprocal licen[cs]e
ms rl: ms rl
[eupl 2 0.92]
european union: european union public licen[cs]e(?: (?:version |v ?)?1 [12])?
eupl: eupl(?: 1 [12])?
[ofl-1.1 2 0.95]
sil: sil open font licen[cs]e(?: (?:version |v ?)?1 [01])?
ofl: ofl 1 [01]
font: this font software is licensed under the sil open font
[afl 2 0.9]
academic: academic free licen[cs]e(?: (?:version |v ?)?[123] [01])?
[osl 2 0.9]
osl: osl 3 0
open software: open software licen[cs]e(?: (?:version |v ?)?[123] 0)?
[cecill 2 0.9]
cecill: cecill(?: [bc])?(?: licen[cs]e)?(?: (?:version |v ?)?[12] [01])?
[bsl-1.1 2 0.92]
business: business source licen[cs]e(?: 1 1)?
busl: busl 1 1
[sspl 2 0.92]
server side: server side public licen[cs]e(?: v ?1)?
sspl: sspl(?: 1 0)?
[elastic-2.0 2 0.92]
elastic: elastic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
[commons-clause 2 0.92]
clause commons: commons clause(?: licen[cs]e)?(?: condition)?
[polyform 2 0.92]
polyform: polyform (?:noncommercial|perimeter|shield|strict|small business|free trial)(?: licen[cs]e)?(?: 1 0 0)?
[rail 2 0.92]
rail: (?:bigscience|creativeml)? ?(?:open ?)?rail(?: m| s| d)? licen[cs]e
openrail: openrail(?: m)?
responsible ai: responsible ai licen[cs]es?
[model-license 2 0.9]
community: (?:llama|gemma|falcon)(?: [0-9]+)*(?: community)? licen[cs]e(?: agreement)?
model terms: model licen[cs]e terms
[beerware 2 0.9]
beer: beer ?ware(?: licen[cs]e)?
beer buy: you can buy me a beer in return
[json 2 0.9]
good evil: shall be used for good not evil
[vim 3 0.85]
vim: vim licen[cs]e
charityware: charityware
[unicode 3 0.85]
unicode: unicode(?: inc)? licen[cs]e(?: agreement)?
icu: icu licen[cs]e
[curl 3 0.85]
curl: curl licen[cs]e
[ruby 3 0.85]
ruby: ruby licen[cs]e
[tcl 3 0.85]
tcl: tcl(?: tk)? licen[cs]e
[w3c 3 0.85]
w3c: w3c (?:software(?: and document)?|document) (?:notice and )?licen[cs]e
[intel 3 0.85]
intel: intel (?:simplified )?(?:open source )?(?:software )?licen[cs]e(?: agreement)?
[nvidia 3 0.85]
nvidia: nvidia (?:source code )?(?:software )?licen[cs]e(?: agreement)?
[oracle 3 0.85]
oracle: oracle (?:binary code|technology network|free use terms)(?: and conditions)? ?licen[cs]e(?: agreement)?
[eula 3 0.8]
end user: end user licen[cs]e agreement
eula: eula
shareware: shareware
freeware: freeware
[proprietary 3 0.8]
proprietary confidential: proprietary and confidential
confidential proprietary: confidential and proprietary
trade secrets: (?:contains )?trade secrets(?: of| and| or)
unauthorized prohibited: unauthorized (?:copying|use|reproduction|distribution) .. (?:strictly )?prohibited
commercial only: (?:for )?non ?commercial use only
internal only: for internal use only
[no-reproduction 3 0.8]
reproduced part: no part of this .. may be reproduced
reproduced permission: (?:may|must) not be reproduced .. without .. permission
reproduction prohibited: reproduction .. prohibited
redistribution prohibited: redistribution (?:is )?(?:strictly )?prohibited
permission written: without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)
reprinted permission: reprinted (?:with|by) permission
used permission: used (?:with|by) permission
[no-training 2 0.95]
training ai: may not be used (?:for|in) training .. (?:ai|models?)
train ai: may not be used to train .. (?:ai|models?)
tdm reservation: tdm reservation(?: protocol)?
text mining: text and data mining .. (?:reserved|prohibited)
[reserved 4 0.5]
reserved: all right reserved
reserved: rights reserved worldwide
vorbehalten: alle rechte vorbehalten
derechos: todos los derechos reservados
droits: tous droits r\xc3\xa9serv\xc3\xa9s
diritti: tutti i diritti riservati
direitos: todos os direitos reservados
[copyright 4 0.5]
copyright: copyright(?: c| \xc2\xa9)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*
copyright: copyright (?:by|holders?|owner|notice)
copyrighted: (?:is |are )?copyrighted (?:by|material|work)
copyright: protected by copyright(?: laws?)?
copyright: copyright infringement
dmca: dmca
[warranty 4 0.5]
warranty provided: (?:is )?provided as is without warranty of any kind
merchantability: implied warrant(?:y|ies) of merchantability
liable event: in no event shall .. be liable
fitness purpose: fitness for a particular purpose
[permissive 4 0.5]
free distribute: free to use (?:copy )?(?:modify )?(?:and |or )?distribute
free redistribute: free to use (?:copy )?(?:modify )?(?:and |or )?redistribute
royalty: royalty free(?: licen[cs]e)?
open source: open source licen[cs]e
free software: free software licen[cs]e
[gpl 4 0.5]
public general: general public licence
[license 5 0.3]
licensed: licensed under (?:the |a |an )?(?:terms of )?(?:the )?(?:following )?licen[cs]e
license: see (?:the )?license(?: file)?(?: for details)?
license: license agreement
licence: licence agreement
license: terms of (?:the |this )?license
licence: terms of (?:the |this )?licence
spdx: spdx license identifier
"""


@dataclass(frozen=True)
class Rule:
    """One signature; ``number`` is its place in the order."""

    number: int
    label: str
    priority: int
    confidence: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    base: bool = False


def compiled(pattern: str) -> re.Pattern[bytes]:
    """A pattern over words: it starts after a blank and ends before one."""
    return re.compile(b" (?:" + pattern.replace(" .. ", "(?: [^ ]+){0,6}? ").encode() + b")(?= )")


def parsed(text: str = RULES_TEXT, base: dict[str, str] = BASE) -> list[Rule]:
    """The rules of a text in the form above, after those of the base phrases."""
    rules = [
        Rule(i, label, 4, 0.5, tuple(w.encode() for w in phrase.split()), compiled(phrase), True)
        for i, (phrase, label) in enumerate(base.items())
    ]
    label, priority, confidence = "", 0, 0.0
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("["):
            label, rank, sure = line.strip("[]").split(" ")
            priority, confidence = int(rank), float(sure)
        else:
            words, _, pattern = line.partition(": ")
            rules.append(Rule(len(rules), label, priority, confidence, tuple(w.encode() for w in words.split()), compiled(pattern)))
    return rules
