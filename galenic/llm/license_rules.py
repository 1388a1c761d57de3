"""Signature rules of the licence scanner, in order of precedence.

Each family is `label | keyword | regexes separated by ;;`. A regex is matched against a text's
words joined by single spaces, so it needs no punctuation and no case. `keyword` is a literal
without which none of the family's regexes can match; it gates them. The number before a regex is
its priority: 3 for a notice or identifier that states the licence, 2 for a name or address,
1 for a hint.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rank: int
    label: str
    keyword: str
    regex: str
    priority: int
    base: bool


#: Phrases whose every place counts as a base detection.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

FAMILIES = r"""
mit | mit | 3 spdx license identifier mit ;; 3 (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e ;; 2 the mit licen[cs]e ;; 2 mit licen[cs]ed? ;; 2 opensource org licenses mit ;; 2 licen[cs]e mit
mit | permission is hereby granted free of charge | 3 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | mit | 3 spdx license identifier mit 0 ;; 3 mit no attribution(?: licen[cs]e)?
x11 | x11 | 3 spdx license identifier x11 ;; 2 x11 licen[cs]e ;; 2 mit x11(?: licen[cs]e)?
expat | expat | 2 expat licen[cs]e ;; 2 licen[cs]ed under (?:the )?expat
apache-2 | apache | 3 spdx license identifier apache 2 0 ;; 3 (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache licen[cs]e(?: version)? v?2(?: 0)? ;; 2 apache licen[cs]e v?2(?: 0)? ;; 2 apache 2(?: 0)? licen[cs]ed? ;; 2 www apache org licenses license 2 0 ;; 2 apache software licen[cs]e(?: version)? 2(?: 0)? ;; 2 licen[cs]e apache 2(?: 0)?
apache-1.1 | apache | 3 spdx license identifier apache 1 1 ;; 2 apache (?:software )?licen[cs]e(?: version)? 1 1
apache-1.0 | apache | 3 spdx license identifier apache 1 0 ;; 2 apache (?:software )?licen[cs]e(?: version)? 1 0
apache | apache | 1 apache (?:software )?licen[cs]e
gpl-2.0-only | gpl | 3 spdx license identifier gpl 2 0(?: only)? ;; 2 gpl ?v?2(?: 0)? only ;; 2 licen[cs]e gpl ?v?2(?: 0)? ;; 2 gpl ?v2
gpl-2.0-only | general public licen | 3 gnu general public license version 2 as published by the free software foundation ;; 2 gnu general public licen[cs]e(?: version)? v?2(?: 0)?
gpl-2.0-or-later | gpl | 3 spdx license identifier gpl 2 0 or later ;; 2 gpl ?v?2(?: 0)? or later
gpl-2.0-or-later | general public license | 3 gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-only | gpl | 3 spdx license identifier gpl 3 0(?: only)? ;; 2 gpl ?v?3(?: 0)? only ;; 2 licen[cs]e gpl ?v?3(?: 0)? ;; 2 gpl ?v3
gpl-3.0-only | general public licen | 2 gnu general public licen[cs]e(?: version)? v?3(?: 0)?
gpl-3.0-or-later | gpl | 3 spdx license identifier gpl 3 0 or later ;; 2 gpl ?v?3(?: 0)? or later
gpl-3.0-or-later | general public license | 3 gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-1.0 | gpl | 3 spdx license identifier gpl 1 0(?: only| or later)? ;; 2 gpl ?v?1(?: 0)?
gpl | gpl | 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl ;; 1 gnu gpl ;; 1 gpl licen[cs]ed?
gpl | general public license | 1 (?:gnu )?general public license
lgpl-2.0 | lgpl | 3 spdx license identifier lgpl 2 0(?: only| or later)? ;; 2 lgpl ?v?2(?: 0)?
lgpl-2.1 | lgpl | 3 spdx license identifier lgpl 2 1(?: only| or later)? ;; 2 lgpl ?v?2 1
lgpl-2.1 | lesser general public | 3 gnu lesser general public license as published by the free software foundation either version 2 1 of the license ;; 2 gnu lesser general public licen[cs]e(?: version)? v?2 1
lgpl-3.0 | lgpl | 3 spdx license identifier lgpl 3 0(?: only| or later)? ;; 2 lgpl ?v?3(?: 0)?
lgpl-3.0 | lesser general public | 3 gnu lesser general public license as published by the free software foundation either version 3 of the license ;; 2 gnu lesser general public licen[cs]e(?: version)? v?3(?: 0)?
lgpl | lgpl | 1 (?:gnu )?lgpl(?: licen[cs]ed?)?
lgpl | general public | 2 gnu (?:lesser|library) general public licen[cs]e
agpl-3.0 | agpl | 3 spdx license identifier agpl 3 0(?: only| or later)? ;; 2 agpl ?v?3(?: 0)?(?: or later)?
agpl-3.0 | affero | 3 gnu affero general public license as published by the free software foundation either version 3 ;; 2 gnu affero general public licen[cs]e(?: version)? v?3(?: 0)?
agpl-1.0 | agpl | 3 spdx license identifier agpl 1 0
agpl-1.0 | affero | 2 affero general public licen[cs]e(?: version)? 1(?: 0)?
agpl | affero | 2 (?:gnu )?affero general public licen[cs]e
bsd-2-clause | bsd | 3 spdx license identifier bsd 2 clause ;; 2 (?:simplified|freebsd|2 clause|two clause) bsd(?: style)? licen[cs]e ;; 2 bsd (?:2|two) clause(?: licen[cs]e)? ;; 2 opensource org licenses bsd 2 clause
bsd-3-clause | bsd | 3 spdx license identifier bsd 3 clause ;; 2 (?:modified|revised|new|3 clause|three clause) bsd(?: style)? licen[cs]e ;; 2 bsd (?:3|three) clause(?: licen[cs]e)? ;; 2 opensource org licenses bsd 3 clause
bsd-3-clause | neither the name of | 3 neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | bsd | 3 spdx license identifier bsd 4 clause ;; 2 (?:original|old|4 clause|four clause) bsd licen[cs]e ;; 2 bsd (?:4|four) clause(?: licen[cs]e)?
bsd-4-clause | all advertising materials | 3 all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-1-clause | bsd | 3 spdx license identifier bsd 1 clause ;; 2 bsd (?:1|one) clause(?: licen[cs]e)?
0bsd | bsd | 3 spdx license identifier 0bsd ;; 2 (?:zero clause|0 clause) bsd(?: licen[cs]e)? ;; 2 0bsd
bsd | bsd | 2 (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?bsd licen[cs]e ;; 1 bsd(?: style)? licen[cs]ed?
bsd | redistribution and use in source and binary forms | 2 redistribution and use in source and binary forms with or without modification are permitted
isc | isc | 3 spdx license identifier isc ;; 2 isc licen[cs]ed? ;; 2 opensource org licenses isc
isc | permission to use copy modify | 2 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-1.1 | mpl | 3 spdx license identifier mpl 1 1 ;; 2 mpl ?v?1 1
mpl-1.1 | mozilla public | 3 contents of this file are subject to the mozilla public license version 1 1 ;; 2 mozilla public licen[cs]e(?: version)? v?1 1
mpl-2.0 | mpl | 3 spdx license identifier mpl 2 0(?: no copyleft exception)? ;; 2 mpl ?v?2(?: 0)?
mpl-2.0 | mozilla public | 3 subject to the terms of the mozilla public license v 2 0 ;; 2 mozilla public licen[cs]e(?: version)? v? ?2(?: 0)?
mpl-2.0 | mozilla org | 2 mozilla org mpl 2 0
mpl | mozilla public | 1 mozilla public licen[cs]e
epl-1.0 | epl | 3 spdx license identifier epl 1 0 ;; 2 epl ?v?1(?: 0)?
epl-1.0 | eclipse public | 2 eclipse public licen[cs]e(?: version)? v? ?1(?: 0)?
epl-2.0 | epl | 3 spdx license identifier epl 2 0 ;; 2 epl ?v?2(?: 0)?
epl-2.0 | eclipse public | 2 eclipse public licen[cs]e(?: version)? v? ?2(?: 0)?
epl | eclipse public | 1 eclipse public licen[cs]e
edl-1.0 | eclipse distribution | 2 eclipse distribution licen[cs]e(?: version)?(?: v? ?1(?: 0)?)?
cddl-1.0 | cddl | 3 spdx license identifier cddl 1 0 ;; 2 cddl ?v?1(?: 0)? ;; 1 cddl licen[cs]ed?
cddl-1.1 | cddl | 3 spdx license identifier cddl 1 1 ;; 2 cddl ?v?1 1
cddl | common development and distribution | 2 common development and distribution licen[cs]e
cpl-1.0 | cpl | 3 spdx license identifier cpl 1 0
cpl-1.0 | common public | 2 common public licen[cs]e(?: version)?(?: 1(?: 0)?)?
cpal-1.0 | common public attribution | 2 common public attribution licen[cs]e(?: version)?(?: 1(?: 0)?)?
eupl-1.1 | eupl | 3 spdx license identifier eupl 1 1 ;; 2 eupl ?v?1 1
eupl-1.2 | eupl | 3 spdx license identifier eupl 1 2 ;; 2 eupl ?v?1 2 ;; 1 licen[cs]ed under (?:the )?eupl
eupl | european union public | 2 european union public licen[cs]e
ms-pl | ms pl | 3 spdx license identifier ms pl
ms-pl | microsoft public | 2 microsoft public licen[cs]e ;; 2 licen[cs]ed under (?:the )?microsoft public
ms-pl | ms pl | 2 ms pl(?: licen[cs]ed?)?
ms-rl | microsoft reciprocal | 2 microsoft reciprocal licen[cs]e
artistic-1.0 | artistic | 3 spdx license identifier artistic 1 0(?: perl)? ;; 2 artistic licen[cs]e(?: version)? 1(?: 0)?
artistic-2.0 | artistic | 3 spdx license identifier artistic 2 0 ;; 2 artistic licen[cs]e(?: version)? 2(?: 0)?
artistic | artistic | 1 (?:perl )?artistic licen[cs]e ;; 2 same terms as perl itself under the artistic licen[cs]e
perl | same terms as perl | 2 under the same terms as perl(?: itself)?
psf-2.0 | python software foundation | 2 python software foundation licen[cs]e(?: version)?(?: 2(?: 0)?)?
psf-2.0 | psf | 1 psf licen[cs]e
python-2.0 | python | 3 spdx license identifier python 2 0
python-2.0 | psf | 3 spdx license identifier psf 2 0
python-2.0 | python | 2 python licen[cs]e(?: version)? 2(?: 0)?
ruby | ruby | 3 spdx license identifier ruby ;; 2 ruby licen[cs]e ;; 2 same terms as ruby
php-3.0 | php | 3 spdx license identifier php 3 0 ;; 2 php licen[cs]e(?: version)? v?3(?: 0)?
php-3.01 | php | 3 spdx license identifier php 3 01 ;; 2 php licen[cs]e(?: version)? v?3 01
zlib | zlib | 3 spdx license identifier zlib ;; 2 zlib(?: libpng)? licen[cs]ed? ;; 2 opensource org licenses zlib
zlib | altered source versions | 3 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | libpng | 3 spdx license identifier libpng(?: 2 0)? ;; 2 libpng licen[cs]e
bsl-1.0 | bsl | 3 spdx license identifier bsl 1 0
bsl-1.0 | boost | 3 distributed under the boost software license version 1 0 ;; 2 boost software licen[cs]e(?: version)?(?: v?1(?: 0)?)? ;; 2 boost org license 1 0 txt
unlicense | unlicense | 3 spdx license identifier unlicense ;; 2 the unlicense ;; 2 unlicense org
unlicense | free and unencumbered software | 3 this is free and unencumbered software released into the public domain
wtfpl | wtfpl | 3 spdx license identifier wtfpl ;; 2 wtfpl(?: licen[cs]ed?)?(?: version 2)?
wtfpl | what the fuck you want | 2 do what the fuck you want to public licen[cs]e
cc0-1.0 | cc0 | 3 spdx license identifier cc0 1 0 ;; 2 cc0(?: 1 0)?(?: universal)?
cc0-1.0 | creativecommons org | 2 creativecommons org publicdomain zero 1 0
cc0-1.0 | creative commons zero | 2 creative commons zero(?: v?1 0)?(?: universal)?
cc-by-1.0 | cc by | 3 spdx license identifier cc by 1 0 ;; 2 cc by 1 0
cc-by-2.0 | cc by | 3 spdx license identifier cc by 2 0 ;; 2 cc by 2 0
cc-by-2.5 | cc by | 3 spdx license identifier cc by 2 5 ;; 2 cc by 2 5
cc-by-3.0 | cc by | 3 spdx license identifier cc by 3 0 ;; 2 cc by 3 0
cc-by-4.0 | cc by | 3 spdx license identifier cc by 4 0 ;; 2 cc by 4 0
cc-by-sa-2.5 | cc by sa | 2 cc by sa 2 5
cc-by-sa-3.0 | cc by sa | 3 spdx license identifier cc by sa 3 0 ;; 2 cc by sa 3 0
cc-by-sa-4.0 | cc by sa | 3 spdx license identifier cc by sa 4 0 ;; 2 cc by sa 4 0
cc-by-nd-4.0 | cc by nd | 3 spdx license identifier cc by nd 4 0 ;; 2 cc by nd 4 0
cc-by-nc-4.0 | cc by nc | 3 spdx license identifier cc by nc 4 0 ;; 2 cc by nc 4 0
cc-by-nc-3.0 | cc by nc | 3 spdx license identifier cc by nc 3 0 ;; 2 cc by nc 3 0
cc-by-nc-sa-4.0 | cc by nc sa | 3 spdx license identifier cc by nc sa 4 0 ;; 2 cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc by nc sa | 3 spdx license identifier cc by nc sa 3 0 ;; 2 cc by nc sa 3 0
cc-by-nc-nd-4.0 | cc by nc nd | 3 spdx license identifier cc by nc nd 4 0 ;; 2 cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc by nc nd | 2 cc by nc nd 3 0
cc-by-nc-sa | cc by nc sa | 2 cc by nc sa
cc-by-nc-nd | cc by nc nd | 2 cc by nc nd
cc-by-sa | cc by sa | 2 cc by sa(?: licen[cs]ed?)?
cc-by-nd | cc by nd | 2 cc by nd(?: licen[cs]ed?)?
cc-by | cc by | 1 cc by(?: licen[cs]ed?)
cc-by-nc | creative commons | 3 creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)? licen[cs]e ;; 2 creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nc-sa | creative commons | 3 creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nc-nd | creative commons | 3 creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa | creative commons | 3 creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd | creative commons | 3 creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by | creative commons | 2 creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc | creative commons | 1 creative commons(?: licen[cs]e)? ;; 1 licen[cs]ed under (?:a )?creative commons
cc-by | creativecommons org | 2 creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org | 2 creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons org | 2 creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons org | 2 creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons org | 2 creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons org | 2 creativecommons org licenses by nc nd [1-4] [05]
odbl-1.0 | odbl | 3 spdx license identifier odbl 1 0 ;; 2 odbl(?: 1 0)?
odbl-1.0 | open database | 2 open database licen[cs]e(?: odbl)?(?: v?1 0)?
odc-by-1.0 | open data commons attribution | 2 open data commons attribution licen[cs]e(?: v?1 0)?
odc-by-1.0 | odc by | 3 spdx license identifier odc by 1 0 ;; 2 odc by(?: 1 0)?
pddl-1.0 | public domain dedication and license | 2 public domain dedication and license(?: v?1 0)?
gfdl-1.2 | documentation licen | 2 gnu free documentation licen[cs]e(?: version)? 1 2
gfdl-1.3 | documentation licen | 2 gnu free documentation licen[cs]e(?: version)? 1 3
gfdl | gfdl | 3 spdx license identifier gfdl 1 [123](?: only| or later)? ;; 2 gfdl
gfdl | documentation license | 1 (?:gnu )?free documentation license
ofl-1.1 | sil open font | 3 sil open font licen[cs]e version 1 1 ;; 2 sil open font licen[cs]e
ofl-1.1 | ofl | 3 spdx license identifier ofl 1 1 ;; 2 scripts sil org ofl
ncsa | ncsa | 3 spdx license identifier ncsa ;; 2 (?:university of illinois )?ncsa open source licen[cs]e
afl-3.0 | academic free | 3 licensed under the academic free license version 3 0 ;; 2 academic free licen[cs]e(?: version)?(?: v?[123](?: [01])?)?
afl-3.0 | afl | 3 spdx license identifier afl 3 0
osl-3.0 | open software license | 3 licensed under the open software license version 3 0 ;; 2 open software license(?: version)?(?: v?[123](?: 0)?)?
osl-3.0 | osl | 3 spdx license identifier osl 3 0
upl-1.0 | universal permissive | 2 universal permissive licen[cs]e(?: version)?(?: v?1(?: 0)?)?
upl-1.0 | upl | 3 spdx license identifier upl 1 0
blueoak-1.0.0 | blue oak | 2 blue oak model licen[cs]e(?: 1 0 0)?
blueoak-1.0.0 | blueoak | 3 spdx license identifier blueoak 1 0 0
qpl-1.0 | q public license | 2 (?:the )?q public license(?: version)?(?: 1 0)?
ipl-1.0 | ibm public | 2 ibm public licen[cs]e(?: version)?(?: 1(?: 0)?)?
spl-1.0 | sun public | 2 sun public licen[cs]e(?: version)?(?: 1(?: 0)?)?
sissl | sun industry standards | 2 sun industry standards source licen[cs]e
npl-1.1 | netscape public | 2 netscape public licen[cs]e(?: version)?(?: 1 [01])?
apsl-2.0 | apple public source | 2 apple public source licen[cs]e(?: version)?(?: 2(?: 0)?)?
w3c | w3c | 3 spdx license identifier w3c ;; 2 w3c software (?:notice and )?licen[cs]e ;; 2 w3c licen[cs]e
openssl | openssl | 3 spdx license identifier openssl ;; 2 openssl licen[cs]e ;; 2 openssl and ssleay licen[cs]e
curl | curl | 3 spdx license identifier curl ;; 2 curl licen[cs]e
postgresql | postgresql | 3 spdx license identifier postgresql ;; 2 postgresql licen[cs]e ;; 2 licen[cs]ed under (?:the )?postgresql
ntp | ntp | 3 spdx license identifier ntp ;; 2 ntp licen[cs]e
unicode-dfs | unicode | 3 spdx license identifier unicode (?:dfs 201[56]|3 0) ;; 2 unicode licen[cs]e(?: v3| agreement)?
icu | icu | 3 spdx license identifier icu ;; 2 icu licen[cs]e
tcl | tcl | 3 spdx license identifier tcl ;; 2 tcl(?: tk)? licen[cs]e
vim | vim | 3 spdx license identifier vim ;; 2 vim licen[cs]e
beerware | beer | 3 spdx license identifier beerware ;; 2 beer ?ware licen[cs]e
json | json | 3 spdx license identifier json ;; 2 json licen[cs]e
json | good not evil | 3 the software shall be used for good not evil
ijg | jpeg group | 2 independent jpeg group(?: s)? licen[cs]e
freetype | ftl | 3 spdx license identifier ftl
freetype | freetype | 2 freetype (?:project )?licen[cs]e
imagemagick | imagemagick | 3 spdx license identifier imagemagick ;; 2 imagemagick licen[cs]e
lppl-1.3c | latex project public | 2 latex project public licen[cs]e(?: version)?(?: 1 3(?: c)?)?
lppl-1.3c | lppl | 3 spdx license identifier lppl 1 3c ;; 2 lppl(?: version)?(?: 1 3c?)?
mulanpsl-2.0 | mulan | 3 spdx license identifier mulanpsl 2 0 ;; 2 mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?(?: ?v2)?
cecill-2.1 | cecill | 3 spdx license identifier cecill 2 1 ;; 2 cecill(?: b| c)?(?: licen[cs]e)?(?: version 2(?: [01])?)?
sspl-1.0 | server side public | 3 server side public license version 1 ;; 2 server side public licen[cs]e
sspl-1.0 | sspl | 3 spdx license identifier sspl 1 0 ;; 2 sspl(?: v?1(?: 0)?)?
busl-1.1 | business source | 3 business source license 1 1 ;; 2 business source licen[cs]e
busl-1.1 | busl | 3 spdx license identifier busl 1 1 ;; 2 busl(?: 1 1)?
elastic-2.0 | elastic | 3 spdx license identifier elastic 2 0 ;; 2 elastic licen[cs]e(?: version)?(?: v?2(?: 0)?)?
polyform | polyform | 3 spdx license identifier polyform (?:noncommercial|small business) 1 0 0 ;; 2 polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e
commons-clause | commons clause | 2 commons clause(?: licen[cs]e)?(?: condition)?
openrail | openrail | 2 (?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?
rail | responsible ai license | 2 responsible ai license
cdla-permissive | community data license | 3 community data license agreement permissive(?: version)?(?: [12] 0)? ;; 2 community data license agreement
cdla-permissive | cdla | 3 spdx license identifier cdla permissive [12] 0 ;; 2 cdla permissive
ogl-uk-3.0 | open government | 2 open government licen[cs]e(?: v?[123](?: 0)?)?
etalab-2.0 | licence ouverte | 2 licence ouverte open licence
etalab-2.0 | etalab | 2 etalab(?: open)? licen[cs]e
public-domain | public domain | 2 (?:released|dedicated|placed) (?:in|in to|into|to) the public domain ;; 1 this work is in the public domain ;; 1 public domain software
all-rights-reserved | rights reserved | 1 all rights reserved ;; 1 alle rechte vorbehalten all rights reserved ;; 2 copyright(?: c)?(?: (?:19|20)[0-9]{2})(?: [^ ]+){1,8} all rights reserved
all-rights-reserved | alle rechte vorbehalten | 1 alle rechte vorbehalten
all-rights-reserved | tous droits | 1 tous droits r[eé]serv[eé]s
all-rights-reserved | todos los derechos | 1 todos los derechos reservados
proprietary | proprietary | 2 (?:confidential and proprietary|proprietary and confidential) ;; 2 proprietary (?:software )?licen[cs]e ;; 1 unauthorized copying of this file proprietary
proprietary | unauthorized copying | 2 unauthorized copying of this file via any medium is strictly prohibited
copyright | copyright | 1 copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})? ;; 1 copyright holders? ;; 1 copyright notice
spdx-other | spdx license identifier | 1 spdx license identifier [^ ]+
dual-license | dual | 2 dual licen[cs]ed(?: under)? ;; 1 dual licen[cs](?:e|ing)
non-commercial | commercial | 2 (?:for )?non ?commercial use only ;; 1 non ?commercial (?:research )?purposes only
free-software | free software | 1 this (?:program|library) is free software you can redistribute it ;; 1 free software license
eula | end user | 2 end user licen[cs]e agreement
shareware | shareware | 2 shareware licen[cs]e ;; 1 this is shareware
"""


def rules() -> list[Rule]:
    """All rules: the base phrases first, then the families' regexes as written."""
    out = [Rule(i, label, phrase, phrase, 3, True) for i, (label, phrase) in enumerate(BASE)]
    for line in filter(None, FAMILIES.splitlines()):
        label, keyword, regexes = (x.strip() for x in line.split(" | "))
        for regex in regexes.split(";;"):
            priority, pattern = regex.strip().split(" ", 1)
            out.append(Rule(len(out), label, keyword, pattern, int(priority), False))
    return out


#: One of these words stands in every rule's every match: texts without one need no rule.
ANCHORS = (
    "licen[cs]e[ds]?|licen[cs]ing|unlicense|mit|(?:[al]?gpl|mpl|epl|cddl|eupl)(?:v?[0-9]+)?|bsd|0bsd|wtfpl|cc0?|creative|creativecommons|"
    "gfdl|odbl|odc|ofl|cecill|lppl|sspl|busl|beer|beerware|mulan|openrail|cdla|permission|permitted|copyright|public|perl|"
    "endorse|advertising|altered|unencumbered|granted|rights|rechte|droits|derechos|proprietary|unauthorized|commercial|commercial|"
    "noncommercial|commons|good|apache|ruby|free|shareware|expat|x11|etalab|licence|open|ms|boost"
)
