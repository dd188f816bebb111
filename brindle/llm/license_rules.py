"""Signatures written by hand: what license texts, notices and headers say, over words in lower case.

One a line: label, priority, keywords of which one must be in the text, and a regex over words
with one space between them. The prefilter reads the keywords only.
"""

#: Sentences of the licenses and of the notices that they ask for, and names as they are usually written.
WRITTEN = r"""
agpl-3-or-later | 95 | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3-only | 95 | affero | gnu affero general public license version 3 as published by the free software foundation
agpl-3 | 70 | affero | gnu affero general public license version 3 19 november 2007
agpl-3-or-later | 92 | affero agpl | (?:gnu affero general public license|agpl)(?: version)? (?:v )?v?3(?: 0)?(?: or later|or newer| or any later version)
lgpl-2-or-later | 95 | library | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl-2.1-or-later | 95 | lesser | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3-or-later | 95 | lesser | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-only | 95 | lesser | gnu lesser general public license version 2 1 as published by the free software foundation
lgpl-3-only | 95 | lesser | gnu lesser general public license version 3 as published by the free software foundation
lgpl-2.1 | 70 | lesser | gnu lesser general public license version 2 1 february 1999
lgpl-3 | 70 | lesser | gnu lesser general public license version 3 29 june 2007
lgpl-2 | 70 | library | gnu library general public license version 2 june 1991
gpl-1-or-later | 95 | gnu | gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl-2-or-later | 95 | gnu | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3-or-later | 95 | gnu | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2-only | 95 | gnu | gnu general public license(?: version 2)? as published by the free software foundation version 2(?: of the license)?
gpl-2-only | 95 | gnu | gnu general public license version 2 as published by the free software foundation
gpl-3-only | 95 | gnu | gnu general public license version 3 as published by the free software foundation
gpl-2 | 70 | gnu | gnu general public license version 2 june 1991
gpl-3 | 70 | gnu | gnu general public license version 3 29 june 2007
gpl | 55 | gnu | you should have received a copy of the gnu general public license
lgpl | 56 | gnu | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | 56 | gnu | you should have received a copy of the gnu affero general public license
gpl-3 | 60 | quick | a quick guide to gplv3
gpl-exception | 58 | exception | (?:with )?(?:the )?gcc runtime library exception
gpl-exception | 58 | exception | (?:with )?(?:the )?classpath exception
gpl-exception | 58 | exception | as a special exception(?: the)? (?:[a-z]+ ){0,12}permission to link
gpl-exception | 58 | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
linux-syscall-note | 58 | syscall | linux syscall note
llvm-exception | 58 | llvm | (?:with )?llvm exceptions?
gfdl-1.1-or-later | 95 | documentation | gnu free documentation license version 1 1 or any later version published by the free software foundation
gfdl-1.2-or-later | 95 | documentation | gnu free documentation license version 1 2 or any later version published by the free software foundation
gfdl-1.3-or-later | 95 | documentation | gnu free documentation license version 1 3 or any later version published by the free software foundation
gfdl | 50 | invariant | with no invariant sections no front cover texts and no back cover texts
apache-2 | 90 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 70 | apache | apache license version 2 0 january 2004
apache-2 | 65 | apache | (?:www )?apache org licenses license 2 0
apache-1.1 | 70 | apache | the apache software license version 1 1
apache-1 | 60 | apache | this product includes software developed by the apache group
apache-1.1 | 60 | apache | this product includes software developed by the apache software foundation
apache-2 | 62 | apache | apache ?2(?: 0)? licen[cs]ed?
apache-2 | 62 | asl | asl ?v?2(?: 0)?
mit | 88 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | 50 | hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | 52 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 65 | opensource | opensource org licenses mit(?: license)?(?: php)?
mit-0 | 70 | mit | (?:mit 0|mit no attribution)(?: licen[cs]e)?
mit-cmu | 55 | cmu | mit cmu|cmu (?:style )?licen[cs]e
x11 | 62 | x11 consortium | x11 licen[cs]e|name of the x consortium shall not be used in advertising
ntp | 50 | purpose | permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted
isc | 52 | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc | 50 | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
0bsd | 64 | 0bsd bsd | 0bsd|bsd zero clause licen[cs]e|zero clause bsd
bsd-1 | 64 | bsd | (?:bsd 1 clause|1 clause bsd|one clause bsd)(?: licen[cs]e)?
bsd-2 | 64 | bsd simplified freebsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd licen[cs]e)(?: licen[cs]e)?
bsd-2-patent | 66 | bsd | bsd 2 clause patent|bsd plus patent
bsd-3 | 64 | bsd new modified revised | (?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?
bsd-3-clear | 66 | bsd | (?:bsd 3 clause clear|clear bsd)(?: licen[cs]e)?
bsd-4 | 64 | bsd original | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?
bsd-4 | 55 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3 | 54 | endorse | neither the name of (?:[a-z0-9]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-2 | 50 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 48 | redistribution | redistribution and use in source and binary forms with or without modification
mpl-2 | 90 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 90 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1 | 90 | mozilla | the contents of this file are subject to the mozilla public license version 1 0
mpl-2 | 65 | mozilla | mozilla org mpl 2 0
mpl-2-no-copyleft | 66 | incompatible | incompatible with secondary licenses as defined by the mozilla public license
npl-1.1 | 70 | netscape | netscape public license version 1 1
epl-1 | 90 | eclipse | made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2 | 90 | eclipse | made available under the terms of the eclipse public license v(?:ersion)? ?2 0
epl-1 | 65 | eclipse | eclipse org legal epl v10
epl-2 | 65 | eclipse | eclipse org legal epl (?:v20|2 0)
edl-1 | 70 | eclipse | eclipse distribution license v(?:ersion)? ?1 0
cpl-1 | 70 | common | common public license (?:version|v) ?1 0
ipl-1 | 70 | ibm | ibm public license(?: version 1 0)?
cddl-1 | 90 | distribution | subject to the terms of the common development and distribution license(?: the license| version 1 0)
cddl-1.1 | 70 | cddl | common development and distribution license(?: cddl)? version 1 1
artistic-2 | 70 | artistic | the artistic license 2 0
artistic-1 | 60 | artistic | the artistic license preamble the intent of this document
artistic-perl | 75 | perl | (?:under the )?same terms as perl(?: 5)?(?: itself)?
boost-1 | 70 | boost | boost software license version 1 0
boost-1 | 65 | boost | boost org license 1 0 txt
zlib | 60 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | 66 | libpng | (?:libpng|png reference library) licen[cs]e(?: version 2)?
unlicense | 70 | unencumbered | this is free and unencumbered software released into the public domain
wtfpl-2 | 70 | fuck | do what the fuck you want to public license
psf-2 | 70 | python | python software foundation license(?: agreement)?(?: version 2)?
python-2 | 70 | cnri | cnri open source license agreement
ofl-1.1 | 80 | sil | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | 65 | sil | scripts sil org ofl
odbl-1 | 70 | odbl database | open database license(?: odbl)?(?: v(?:ersion)? ?1 0)?
odc-by-1 | 70 | commons | open data commons attribution license(?: v(?:ersion)? ?1 0)?
pddl-1 | 70 | pddl dedication | public domain dedication and license(?: v(?:ersion)? ?1 0)?|pddl(?: 1 0)?
cc0-1 | 75 | cc0 | cc0 1 0(?: universal)?
cc0-1 | 70 | commons | creative commons cc0
cc0-1 | 65 | publicdomain | creativecommons org publicdomain zero 1 0
public-domain-mark | 60 | publicdomain | creativecommons org publicdomain mark 1 0
cc-by-1 | 75 | licenses | creativecommons org licenses by 1 0
cc-by-2 | 75 | licenses | creativecommons org licenses by 2 0
cc-by-2.5 | 75 | licenses | creativecommons org licenses by 2 5
cc-by-3 | 75 | licenses | creativecommons org licenses by 3 0
cc-by-4 | 75 | licenses | creativecommons org licenses by 4 0
cc-by-sa-2 | 75 | licenses | creativecommons org licenses by sa 2 0
cc-by-sa-2.5 | 75 | licenses | creativecommons org licenses by sa 2 5
cc-by-sa-3 | 75 | licenses | creativecommons org licenses by sa 3 0
cc-by-sa-4 | 75 | licenses | creativecommons org licenses by sa 4 0
cc-by-nd-3 | 75 | licenses | creativecommons org licenses by nd 3 0
cc-by-nd-4 | 75 | licenses | creativecommons org licenses by nd 4 0
cc-by-nc-2 | 75 | licenses | creativecommons org licenses by nc 2 0
cc-by-nc-3 | 75 | licenses | creativecommons org licenses by nc 3 0
cc-by-nc-4 | 75 | licenses | creativecommons org licenses by nc 4 0
cc-by-nc-sa-3 | 75 | licenses | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4 | 75 | licenses | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3 | 75 | licenses | creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4 | 75 | licenses | creativecommons org licenses by nc nd 4 0
eupl-1.2 | 70 | eupl | eupl ?v?1 2
eupl-1.1 | 70 | eupl | eupl ?v?1 1
eupl | 60 | european | european union public licen[cs]e
ms-pl | 70 | microsoft ms | microsoft public license|ms pl
ms-rl | 70 | microsoft ms | microsoft reciprocal license|ms rl
osl-3 | 70 | osl open | (?:open software license|osl) v?(?:ersion )?3 0
afl-3 | 70 | afl academic | (?:academic free license|afl) v?(?:ersion )?3 0
afl-2.1 | 70 | afl academic | (?:academic free license|afl) v?(?:ersion )?2 1
ecl-2 | 70 | educational | educational community license(?: version 2 0)?
ncsa | 70 | ncsa illinois | university of illinois ncsa open source license|ncsa open source license
upl-1 | 70 | universal | universal permissive license(?: v(?:ersion)? ?1 0)?
postgresql | 70 | postgresql | (?:the )?postgresql licen[cs]e
openssl | 70 | openssl | (?:dual )?openssl(?: and ssleay)? licen[cs]e|this product includes software developed by the openssl project
php-3.01 | 70 | php | (?:the )?php license version 3 01
ruby | 70 | ruby | (?:the )?ruby licen[cs]e|same terms as ruby(?: itself)?
zpl-2.1 | 70 | zope | zope public license(?: zpl)?(?: version 2 1)?
w3c | 70 | w3c | w3c (?:software notice and license|software and document (?:notice and )?license)
vim | 70 | vim | (?:the )?vim licen[cs]e
curl | 70 | curl | (?:the )?curl licen[cs]e
json | 70 | evil | the software shall be used for good not evil
beerware | 70 | beerware beer | (?:the )?beer ?ware licen[cs]e
ijg | 70 | jpeg | based in part on the work of the independent jpeg group
ftl | 70 | freetype | (?:the )?freetype (?:project )?licen[cs]e
tcl | 60 | tcl | tcl tk licen[cs]e
qpl-1 | 70 | q qpl | (?:the )?q public license(?: version 1 0)?|qpl 1 0
sleepycat | 70 | sleepycat | (?:the )?sleepycat licen[cs]e
sspl-1 | 80 | sspl server | server side public license(?: v(?:ersion)? ?1)?|sspl(?: v?1)?
busl-1.1 | 80 | business | business source license(?: 1 1)?
elastic-2 | 80 | elastic | elastic license (?:v )?v?2(?: 0)?
commons-clause | 80 | commons | commons clause license condition(?: v1 0)?
polyform | 80 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use)(?: license)?(?: 1 0 0)?
openrail | 70 | openrail rail | (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?
llama-community | 70 | llama | llama(?: [23](?: [0-9])?)? community license(?: agreement)?
ogl-uk-3 | 70 | government | open government licen[cs]e(?: v(?:ersion)? ?3 0)?
etalab-2 | 70 | etalab | (?:licence ouverte |open licen[cs]e )?etalab(?: 2 0)?
cecill-2.1 | 70 | cecill | cecill(?: v(?:ersion)?)? ?2 1
cecill-b | 70 | cecill | cecill b
cecill-c | 70 | cecill | cecill c
cecill | 60 | cecill | cecill licen[cs]e
mulan-2 | 70 | mulan | mulan (?:psl|permissive software license) v2
public-domain | 45 | domain | (?:released|dedicated|placed|donated) (?:in|into|to) the public domain
public-domain | 42 | domain | this (?:work|file|software|code|text) is in the public domain
public-domain | 42 | copyright | no copyright(?: is)? (?:claimed|reserved)
proprietary | 30 | reserved | all rights reserved
proprietary | 32 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 34 | unauthorized | unauthorized (?:copying|use|reproduction|distribution)(?: or distribution| or reproduction)? of this (?:file|work|software|document)(?: via any medium)? is (?:strictly )?prohibited
proprietary | 34 | permission | (?:may not|no part of this [a-z]+ may) be reproduced (?:[a-z]+ ){0,12}without (?:the )?(?:prior )?written permission
proprietary | 33 | personal | for personal use only
noncommercial | 36 | commercial noncommercial | for non ?commercial use only
research-only | 36 | research | for research (?:purposes|use) only
gpl-3 | 66 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3 | 68 | affero | the gnu affero general public license is a free copyleft license for software and other kinds of works
agpl-3 | 52 | remotely | if your software can interact with users remotely through a computer network
gpl-2 | 66 | placed | a notice placed by the copyright holder saying it may be distributed under the terms of this general public license
gpl | 50 | programmer | you should also get your employer if you work as a programmer
gpl | 56 | incorporating | general public license does not permit incorporating your program into proprietary programs
gpl | 48 | interactive | if the program does terminal interaction make it output a short notice like this when it starts in an interactive mode
lgpl-3 | 68 | lesser | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl-2.1 | 66 | successor | this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license
gfdl | 54 | textbook | to make a manual textbook or other functional and useful document free in the sense of freedom
apache-2 | 56 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 | 54 | recipients | you must give any other recipients of the work or derivative works a copy of this license
apache-2 | 54 | prominent | you must cause any modified files to carry prominent notices stating that you changed the files
apache-1.1 | 62 | apache | the names apache and apache software foundation must not be used to endorse or promote products
apache-1 | 62 | apache | the names apache server and apache group must not be used to endorse or promote products
bsd | 46 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 46 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-4 | 57 | berkeley | this product includes software developed by the university of california berkeley and its contributors
bsd-3-clear | 58 | patent | no express or implied licenses to any party s patent rights are granted by this license
mpl-2 | 68 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | 58 | alternatively | alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later
epl | 68 | eclipse | the accompanying program is provided under the terms of this eclipse public license
cpl | 68 | common | the accompanying program is provided under the terms of this common public license
epl-2 | 62 | secondary | this source code may also be made available under the following secondary licenses
cddl-1 | 62 | opensolaris | you can obtain a copy of the license at usr src opensolaris license
artistic-2 | 62 | establishes | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-1 | 58 | semblance | the copyright holder maintains some semblance of artistic control over the development of the package
boost-1 | 62 | organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | 58 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 56 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense | 66 | anyone | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 62 | unlicense | https? unlicense org
wtfpl-2 | 66 | fuck | you just do what the fuck you want to
psf-2 | 62 | psf | psf hereby grants licensee a nonexclusive royalty free world wide license
python-2 | 62 | beopen | beopen hereby grants licensee a non exclusive royalty free world wide license
ofl-1.1 | 66 | fonts | the fonts including any derivative works can be bundled embedded redistributed and or sold with any software
ofl-1.1 | 66 | font | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
cc0-1 | 66 | deed | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1 | 66 | waived | to the extent possible under law (?:[a-z0-9]+ ){1,12}has waived all copyright and related or neighboring rights
cc-by | 44 | credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | 46 | remix | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nd | 46 | remix | if you remix transform or build upon the material you may not distribute the modified material
cc-by-nc | 44 | material | you may not use the material for commercial purposes
cc | 43 | commons | this work is licensed under a creative commons licen[cs]e
eupl | 56 | licence | you may not use this work except in compliance with the licence
ms-pl | 56 | accept | if you use the software you accept this license if you do not accept the license do not use the software
ncsa | 54 | neither | neither the names of (?:[a-z0-9]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
upl-1 | 58 | forth | subject to the condition set forth below to any person obtaining a copy of this software associated documentation and or data
postgresql | 58 | agreement | for any purpose without fee and without a written agreement is hereby granted
postgresql | 56 | california | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
php-3.01 | 62 | php | the name php must not be used to endorse or promote products derived from this software
php-3.01 | 62 | php | this product includes php software freely available from
openssl | 62 | toolkit | the names openssl toolkit and openssl project must not be used to endorse or promote products
openssl | 62 | cryptographic | this product includes cryptographic software written by eric young
vim | 62 | vim | there are no restrictions on distributing unmodified copies of vim
bzip2 | 62 | bzip2 libbzip2 | (?:lib)?bzip2 licen[cs]e
bzip2 | 64 | libbzip2 | this program bzip2 the associated library libbzip2 and all documentation
unicode | 66 | unicode | to any person obtaining a copy of the unicode data files and any associated documentation
unicode | 62 | unicode | unicode (?:licen[cs]e agreement|license v3|terms of use)
icu | 62 | icu | icu license icu 1 8 1 and later
hpnd | 62 | historical | historical permission notice and disclaimer
lppl-1.3 | 72 | latex | latex project public license (?:version |v)?1 3[a-c]?
lppl | 62 | latex | latex project public license
lppl | 66 | latex | distributed and or modified under the conditions of the latex project public license
apsl-2 | 72 | apple apsl | (?:apple public source license|apsl)(?: version)? 2(?: 0)?
apsl | 62 | apple | apple public source license
spl-1 | 62 | sun | sun public license
sissl | 62 | sun | sun industry standards source license
nokia-1 | 62 | nokia | nokia open source license
intel | 62 | intel | intel open source license
rscpl | 62 | ricoh | ricoh source code public license
lpl-1.02 | 62 | lucent | lucent public license
watcom-1 | 62 | watcom | sybase open watcom public license
motosoto | 62 | motosoto | motosoto open source license
naumen | 62 | naumen | naumen public license
frameworx-1 | 62 | frameworx | frameworx open license
aal | 62 | assurance | attribution assurance license
entessa | 62 | entessa | entessa public license
eudatagrid | 62 | datagrid | eu datagrid software license
rpl-1.5 | 62 | reciprocal | reciprocal public license
cpal-1 | 64 | attribution | common public attribution license
nposl-3 | 66 | profit | non profit open software license
nasa-1.3 | 62 | nasa | nasa open source agreement
multics | 62 | multics | multics license
xnet | 62 | xnet | xnet license
vsl-1 | 62 | vovida | vovida software license
oldap-2.8 | 62 | openldap | openldap public license
ogtsl | 62 | suite | open group test suite license
erlpl-1.1 | 62 | erlang | erlang public license
ypl | 62 | yahoo | yahoo public license
zimbra | 62 | zimbra | zimbra public license
apl-1 | 62 | adaptive | adaptive public license
catosl-1.1 | 62 | trusted | computer associates trusted open source license
parity | 62 | parity | parity public license
prosperity | 62 | prosperity | prosperity public license
blueoak-1 | 62 | oak | blue oak model license
cal-1 | 62 | autonomy | cryptographic autonomy license
hippocratic | 62 | hippocratic | hippocratic license
anti-996 | 62 | 996 | anti 996 license
opl-1 | 62 | publication | open publication license
ocl | 62 | content | open content license
ogl-1 | 62 | game | open game license
free-art | 62 | art | free art license
dsl | 62 | science | design science license
dl-de-by-2 | 62 | germany | data licen[cs]e germany attribution(?: version)? 2 0
dl-de-zero-2 | 62 | germany | data licen[cs]e germany zero(?: version)? 2 0
cdla-permissive | 62 | community | community data license agreement permissive
cdla-sharing | 62 | community | community data license agreement sharing
confluent | 62 | confluent | confluent community license
rsal-2 | 62 | redis | redis source available license
timescale | 62 | timescale | timescale license
fsl-1.1 | 62 | functional | functional source license
cockroach | 62 | cockroachdb | cockroachdb community license
gemma | 62 | gemma | gemma terms of use
tmate | 62 | tmate | tmate open source license
jasper-2 | 62 | jasper | jasper license(?: version)? 2 0
libtiff | 62 | libtiff | libtiff license
giftware | 62 | giftware | giftware license
info-zip | 62 | zip | info zip license
xfree86-1.1 | 62 | xfree86 | xfree86 license(?: version)? 1 1
sgi-b-2 | 62 | sgi | sgi free software license b
sendmail | 62 | sendmail | sendmail license
ipa | 62 | ipa | ipa font license(?: agreement)?
arphic | 62 | arphic | arphic public license
bitstream-vera | 62 | vera | bitstream vera (?:fonts? )?(?:copyright|license)
baekmuk | 62 | baekmuk | baekmuk license
crossword | 62 | crossword | crossword license
gnuplot | 62 | gnuplot | gnuplot license
noncommercial | 38 | purposes | for non ?commercial purposes only
noncommercial | 38 | purposes | for personal and non ?commercial (?:use|purposes)(?: only)?
research-only | 38 | academic | for academic (?:use|research|purposes) only
proprietary | 34 | evaluation | for evaluation purposes only
proprietary | 34 | trade | contains trade secrets (?:and|or) proprietary information
proprietary | 33 | reverse | you may not reverse engineer decompile or disassemble
adobe-glyph | 62 | glyph | adobe glyph list license
zend-2 | 62 | zend | zend license(?: version)? 2 0
"""
