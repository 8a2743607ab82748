"""Hand-written license signatures, the most specific first within a priority.

A line is ``priority | confidence | label | keyword | pattern``: a regular expression over lower-cased
text in which a blank stands for a separator (``SEPARATOR``). The keyword stands in every text that the
pattern finds; it gates the rule. A higher priority wins over what lies inside its interval.
"""

from __future__ import annotations

SEPARATOR = r"[\s,;:()\"'“”‘’*/#_-]{1,8}"

SIGNATURES = r"""
90 | 1.0 | gpl-2.0-only with classpath-exception-2.0 | classpath | gpl-2\.0(?:-only)? with classpath-exception-2\.0
90 | 1.0 | gpl-2.0-or-later with classpath-exception-2.0 | classpath | gpl-2\.0(?:-or-later|\+) with classpath-exception-2\.0
90 | 1.0 | gpl-2.0-only with linux-syscall-note | syscall | gpl-2\.0(?:-only)? with linux-syscall-note
90 | 1.0 | gpl-2.0-or-later with linux-syscall-note | syscall | gpl-2\.0(?:-or-later|\+) with linux-syscall-note
90 | 1.0 | gpl-3.0-or-later with gcc-exception-3.1 | gcc | gpl-3\.0(?:-or-later|\+)? with gcc-exception-3\.1
90 | 1.0 | gpl-2.0-or-later with autoconf-exception | autoconf | gpl-[23]\.0(?:-or-later|\+)? with autoconf-exception-[23]\.0
90 | 1.0 | gpl-2.0-or-later with bison-exception-2.2 | bison | gpl-[23]\.0(?:-or-later|\+)? with bison-exception-2\.2
90 | 1.0 | gpl-2.0-or-later with font-exception-2.0 | font | gpl-[23]\.0(?:-or-later|-only|\+)? with font-exception-2\.0
90 | 1.0 | apache-2.0 with llvm-exception | llvm | apache-2\.0 with llvm-exception
90 | 1.0 | apache-2.0 or mit | apache | apache-2\.0 or mit\b
90 | 1.0 | apache-2.0 or mit | apache | mit or apache-2\.0
90 | 1.0 | gpl-2.0-or-later or mit | gpl | gpl-2\.0(?:-or-later|-only|\+)? or mit\b
90 | 1.0 | gpl-2.0-or-later or mit | gpl | mit or gpl-2\.0(?:-or-later|-only|\+)?
90 | 1.0 | gpl-2.0 or bsd | gpl | gpl-2\.0(?:-or-later|-only|\+)? or bsd-[234]-clause
90 | 1.0 | gpl-2.0 or bsd | gpl | bsd-[234]-clause or gpl-2\.0(?:-or-later|-only|\+)?
90 | 1.0 | mpl-2.0 or gpl-2.0-or-later or lgpl-2.1-or-later | mpl | mpl-(?:1\.1|2\.0) or gpl-2\.0(?:-or-later|\+)? or lgpl-2\.1(?:-or-later|\+)?
90 | 1.0 | epl-2.0 or gpl-2.0 | epl | epl-2\.0 or gpl-2\.0
90 | 1.0 | mit and bsd-3-clause | bsd | mit and bsd-3-clause
90 | 1.0 | apache-2.0 and mit | apache | apache-2\.0 and mit\b
90 | 1.0 | gpl-2.0-or-later | either | free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
90 | 1.0 | gpl-3.0-or-later | either | free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
90 | 1.0 | lgpl-2.1-or-later | either | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2\.1 of the license or at your option any later version
90 | 1.0 | lgpl-2.0-or-later | either | redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
90 | 1.0 | lgpl-3.0-or-later | either | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
90 | 1.0 | agpl-3.0-or-later | affero | redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
88 | 1.0 | gpl-2.0-only | published | under the terms of the gnu general public license as published by the free software foundation version 2 of the license
88 | 1.0 | gpl-3.0-only | published | under the terms of the gnu general public license as published by the free software foundation version 3 of the license
88 | 1.0 | gpl-2.0-only | published | under the terms of the gnu general public license version 2 as published by the free software foundation
88 | 1.0 | gpl-3.0-only | published | under the terms of the gnu general public license version 3 as published by the free software foundation
88 | 1.0 | gpl-2.0-or-later | either | general public license either version 2 of the license or (?:at your option )?any later version
88 | 1.0 | gpl-3.0-or-later | either | general public license either version 3 of the license or (?:at your option )?any later version
86 | 1.0 | gpl-2.0-or-later | later | general public license version 2(?:\.0)? or (?:at your option )?(?:any )?later
86 | 1.0 | gpl-3.0-or-later | later | general public license version 3(?:\.0)? or (?:at your option )?(?:any )?later
86 | 1.0 | lgpl-2.1-or-later | later | lesser general public license version 2\.1 or (?:at your option )?(?:any )?later
86 | 1.0 | lgpl-3.0-or-later | later | lesser general public license version 3(?:\.0)? or (?:at your option )?(?:any )?later
86 | 1.0 | agpl-3.0-or-later | later | affero general public license version 3(?:\.0)? or (?:at your option )?(?:any )?later
86 | 0.9 | gpl-1.0-or-later | general | you should have received a copy of the gnu general public license along with this (?:program|software|library|package|file)
86 | 0.9 | lgpl-2.0-or-later | general | you should have received a copy of the gnu (?:lesser|library and lesser) general public license along with this (?:program|software|library|package|file)
86 | 0.9 | agpl-3.0 | affero | you should have received a copy of the gnu affero general public license along with this (?:program|software|library|package|file)
84 | 0.9 | gpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
84 | 0.9 | lgpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license for more details
84 | 0.9 | agpl | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details
84 | 0.8 | gpl | temple | free software foundation inc (?:59|675|51) (?:temple place|mass(?:achusetts)? ave|franklin st(?:reet)?)[^\n]{0,40}temple place
84 | 0.8 | gpl | franklin | free software foundation inc 51 franklin st(?:reet)?
84 | 0.7 | gpl | copyleft | gnu copyleft
84 | 1.0 | gpl-3.0 | gnu.org | gnu\.org/licenses/gpl-3\.0
84 | 1.0 | gpl-2.0 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
84 | 1.0 | lgpl-3.0 | gnu.org | gnu\.org/licenses/lgpl-3\.0
84 | 1.0 | lgpl-2.1 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
84 | 1.0 | agpl-3.0 | gnu.org | gnu\.org/licenses/agpl-3\.0
84 | 1.0 | gfdl-1.3 | gnu.org | gnu\.org/licenses/fdl-1\.3
80 | 0.8 | gpl | gnu.org | gnu\.org/licenses/gpl\b
80 | 0.8 | lgpl | gnu.org | gnu\.org/licenses/lgpl\b
80 | 0.8 | agpl | gnu.org | gnu\.org/licenses/agpl\b
80 | 0.8 | gfdl | gnu.org | gnu\.org/licenses/fdl\b
80 | 0.6 | gpl | gnu.org | gnu\.org/copyleft
80 | 0.9 | gfdl-1.1 | documentation | gnu free documentation license version 1\.1
80 | 0.9 | gfdl-1.2 | documentation | gnu free documentation license version 1\.2
80 | 0.9 | gfdl-1.3 | documentation | gnu free documentation license version 1\.3
82 | 0.9 | gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
78 | 0.9 | gpl | gnu | gnu gpl\b
78 | 0.9 | lgpl | gnu | gnu lgpl\b
78 | 0.9 | agpl | gnu | gnu agpl\b
79 | 1.0 | gpl-2.0 | gplv2 | \bgplv2\b
79 | 1.0 | gpl-2.0-or-later | gplv2 | \bgplv2\+
79 | 1.0 | gpl-3.0 | gplv3 | \bgplv3\b
79 | 1.0 | gpl-3.0-or-later | gplv3 | \bgplv3\+
79 | 1.0 | lgpl-2.0 | lgplv2 | \blgplv2\b
79 | 1.0 | lgpl-2.1 | lgplv2.1 | \blgplv2\.1
79 | 1.0 | lgpl-3.0 | lgplv3 | \blgplv3\b
79 | 1.0 | agpl-3.0 | agplv3 | \bagplv3\b
90 | 1.0 | apache-2.0 | apache | licensed under the apache license version 2\.0 the license you may not use this file except in compliance with the license
88 | 1.0 | apache-2.0 | apache.org | you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0
86 | 1.0 | apache-2.0 | apache.org | apache\.org/licenses/license-2\.0
86 | 1.0 | apache-1.1 | apache.org | apache\.org/licenses/license-1\.1
86 | 0.9 | apache-2.0 | basis | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
84 | 0.9 | apache-2.0 | compliance | you may not use this (?:file|work|software) except in compliance with the license
84 | 0.9 | apache-2.0 | governing | see the license for the specific language governing permissions and limitations under the license
84 | 0.9 | apache-2.0 | contributor | licensed to the apache software foundation asf under one or more contributor license agreements
84 | 0.9 | apache-1.1 | acknowledgment | this product includes software developed by the apache software foundation[^\n]{0,80}acknowledgment
82 | 0.8 | apache | apache | this product includes software developed (?:by|at) the apache software foundation
80 | 0.9 | apache-2.0 | asl | \basl 2\.0\b
90 | 1.0 | mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
86 | 1.0 | mit | sublicense | including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
86 | 1.0 | mit | portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
84 | 0.9 | mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
84 | 0.9 | mit | tort | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
84 | 1.0 | mit-0 | mit | mit no attribution
84 | 1.0 | x11 | x11 | \bx11 licen[sc]e
84 | 0.9 | x11 | consortium | except as contained in this notice the name of the x consortium shall not be used
82 | 1.0 | mit | opensource.org | opensource\.org/licenses/mit\b
82 | 0.9 | mit | mit | \bmit licen[sc]e\b
82 | 0.9 | mit | mit | \bmit style licen[sc]e\b
82 | 0.9 | mit | expat | \bexpat licen[sc]e\b
90 | 1.0 | bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
86 | 1.0 | bsd-2-clause | retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
86 | 1.0 | bsd-2-clause | reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
88 | 1.0 | bsd-3-clause | endorse | neither the names? of (?:the )?[^\n]{1,80} may be used to endorse or promote products derived from this software without specific prior written permission
88 | 1.0 | bsd-3-clause | endorse | the names? of (?:the )?(?:authors?|contributors|copyright holders?) (?:may|must) not be used to endorse or promote products derived from this software
88 | 1.0 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
86 | 0.9 | bsd-4-clause | berkeley | this product includes software developed by the university of california berkeley
86 | 0.9 | bsd-3-clause | regents | the regents of the university of california
84 | 0.9 | bsd | consequential | in no event shall the (?:regents|authors?|copyright (?:owner|holders?))[^\n]{0,60} be liable for any direct indirect incidental special exemplary or consequential damages
84 | 0.9 | bsd-2-clause-freebsd | freebsd | the views and conclusions contained in the software and documentation are those of the authors[^\n]{0,120}freebsd project
84 | 1.0 | bsd-2-clause | simplified | simplified bsd licen[sc]e
84 | 1.0 | bsd-2-clause | freebsd | freebsd licen[sc]e
84 | 1.0 | bsd-3-clause | new | \bnew bsd licen[sc]e
84 | 1.0 | bsd-3-clause | revised | revised bsd licen[sc]e
84 | 1.0 | bsd-3-clause | modified | modified bsd licen[sc]e
84 | 1.0 | bsd-4-clause | original | original bsd licen[sc]e
84 | 1.0 | 0bsd | 0bsd | \b0bsd\b
84 | 1.0 | 0bsd | zero | zero clause bsd
82 | 0.9 | bsd | bsd | \bbsd style licen[sc]e
82 | 1.0 | bsd-2-clause | opensource.org | opensource\.org/licenses/bsd-2-clause
82 | 1.0 | bsd-3-clause | opensource.org | opensource\.org/licenses/bsd-3-clause
88 | 1.0 | isc | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
88 | 1.0 | 0bsd | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?=\.)
84 | 0.9 | isc | disclaims | the software is provided as is and the author disclaims all warranties with regard to this software
84 | 0.9 | isc | isc | \bisc licen[sc]e\b
82 | 0.9 | hpnd | documentation | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee )?is hereby granted
90 | 1.0 | zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
86 | 1.0 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
86 | 1.0 | zlib | anyone | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
82 | 0.9 | zlib | zlib | \bzlib libpng licen[sc]e
82 | 0.9 | libpng | libpng | \blibpng licen[sc]e
88 | 1.0 | boost-1.0 | boost | distributed under the boost software license version 1\.0
86 | 1.0 | boost-1.0 | boost.org | boost\.org/license_1_0
86 | 1.0 | boost-1.0 | machine | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
90 | 1.0 | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2\.0
88 | 1.0 | mpl-2.0 | mozilla.org | if a copy of the mpl was not distributed with this file you can obtain one at https?://(?:www\.)?mozilla\.org/mpl/2\.0
88 | 1.0 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1\.1
86 | 1.0 | mpl-2.0 | mozilla.org | mozilla\.org/mpl/2\.0
86 | 1.0 | mpl-1.1 | mozilla.org | mozilla\.org/mpl/mpl-1\.1
80 | 0.8 | mpl | mozilla.org | mozilla\.org/mpl
86 | 0.9 | mpl-2.0-no-copyleft-exception | incompatible | this source code form is incompatible with secondary licenses as defined by the mozilla public license
90 | 1.0 | epl-2.0 | eclipse | made available under the terms of the eclipse public license v?(?:ersion )?2\.0
90 | 1.0 | epl-1.0 | eclipse | made available under the terms of the eclipse public license v?(?:ersion )?1\.0
86 | 1.0 | epl-2.0 | eclipse.org | eclipse\.org/legal/epl-(?:v20|2\.0)
86 | 1.0 | epl-1.0 | eclipse.org | eclipse\.org/legal/epl-v10
86 | 1.0 | edl-1.0 | eclipse | eclipse distribution license v?(?:ersion )?1\.0
88 | 1.0 | cddl-1.0 | cddl | the contents of this file are subject to the terms of the common development and distribution license[^\n]{0,60}cddl
86 | 1.0 | cddl-1.0 | opensource.org | opensource\.org/licenses/cddl-?1
84 | 0.9 | cddl-1.0-or-gpl-2.0 | dual | dual license consisting of the cddl v1\.[01] and gpl v2
84 | 1.0 | cpl-1.0 | common | common public license (?:version |v)1\.0
84 | 1.0 | ipl-1.0 | ibm | ibm public license (?:version |v)1\.0
84 | 1.0 | eupl-1.2 | eupl | licensed under the eupl version 1\.2
84 | 1.0 | eupl-1.1 | eupl | licensed under the eupl version 1\.1
84 | 1.0 | artistic-2.0 | artistic | the artistic license 2\.0
84 | 0.9 | artistic-1.0-perl | perl | same terms as perl itself
84 | 0.9 | artistic | perl | perl artistic licen[sc]e
84 | 1.0 | python-2.0 | python | python software foundation licen[sc]e (?:version |v)?2
82 | 0.9 | python | psf | \bpsf licen[sc]e
82 | 0.9 | php-3.01 | php | \bphp licen[sc]e (?:version |v)3\.01
82 | 0.9 | php-3.0 | php | \bphp licen[sc]e (?:version |v)3\.0\b
82 | 0.9 | ruby | ruby | \bruby licen[sc]e\b
82 | 0.9 | vim | vim | \bvim licen[sc]e\b
82 | 0.9 | openssl | openssl | \bopenssl licen[sc]e\b
84 | 1.0 | openssl | openssl | this product includes software developed by the openssl project
84 | 1.0 | ssleay | cryptsoft | eric young eay@cryptsoft\.com
82 | 0.9 | unicode-dfs | unicode | unicode inc licen[sc]e agreement data files and software
82 | 0.9 | icu | icu | \bicu licen[sc]e\b
82 | 0.9 | curl | curl | \bcurl licen[sc]e\b
82 | 0.9 | ntp | ntp | \bntp licen[sc]e\b
82 | 0.9 | postgresql | postgresql | \bpostgresql licen[sc]e\b
82 | 0.9 | ncsa | ncsa | university of illinois ncsa open source licen[sc]e
82 | 0.9 | afl-3.0 | academic | academic free license (?:version |v)?3\.0
82 | 0.9 | osl-3.0 | open | open software license (?:version |v)?3\.0
82 | 0.9 | ms-pl | microsoft | microsoft public licen[sc]e
82 | 0.9 | ms-rl | microsoft | microsoft reciprocal licen[sc]e
82 | 0.9 | upl-1.0 | universal | universal permissive licen[sc]e (?:version |v)?1\.0
82 | 0.9 | bsl-1.1 | business | business source licen[sc]e 1\.1
82 | 0.9 | sspl-1.0 | server | server side public licen[sc]e
82 | 0.9 | elastic-2.0 | elastic | elastic licen[sc]e (?:version |v)?2\.0
82 | 0.9 | commons-clause | clause | commons clause license condition
82 | 0.9 | blueoak-1.0.0 | blue | blue oak model licen[sc]e
82 | 0.9 | hippocratic | hippocratic | hippocratic licen[sc]e
82 | 0.9 | json | evil | the software shall be used for good not evil
82 | 0.9 | beerware | beer | the beer ware licen[sc]e
82 | 0.9 | wtfpl-2.0 | fuck | do what the fuck you want to public licen[sc]e
88 | 1.0 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
86 | 1.0 | unlicense | unlicense.org | \bunlicense\.org\b
84 | 1.0 | unlicense | dedicate | we dedicate any and all copyright interest in the software to the public domain
86 | 1.0 | cc0-1.0 | creativecommons | creativecommons\.org/publicdomain/zero/1\.0
86 | 1.0 | pdm-1.0 | creativecommons | creativecommons\.org/publicdomain/mark/1\.0
84 | 1.0 | cc0-1.0 | waived | has waived all copyright and related or neighboring rights to this work
84 | 0.9 | cc0-1.0 | universal | \bcc0 1\.0 universal
84 | 0.9 | public-domain | dedicated | (?:is|has been|are|was) dedicated to the public domain
84 | 0.9 | public-domain | domain | (?:is|are|was|placed|released|put) (?:in|into|to) the public domain
84 | 0.8 | public-domain | domain | no copyright is claimed[^\n]{0,60}public domain
86 | 1.0 | ofl-1.1 | sil | sil open font license version 1\.1
84 | 1.0 | ofl | scripts.sil.org | scripts\.sil\.org/ofl
82 | 0.9 | ofl-1.1 | reserved | with reserved font name
84 | 1.0 | odbl-1.0 | opendatacommons | opendatacommons\.org/licenses/odbl
84 | 1.0 | odc-by-1.0 | opendatacommons | opendatacommons\.org/licenses/by
84 | 1.0 | pddl-1.0 | opendatacommons | opendatacommons\.org/licenses/pddl
82 | 0.9 | ogl-uk-3.0 | government | open government licen[sc]e v?(?:ersion )?3\.0
82 | 0.9 | ogl-uk | government | open government licen[sc]e
82 | 0.9 | etalab-2.0 | etalab | licence ouverte[^\n]{0,30}etalab
82 | 0.9 | cecill-2.1 | cecill | \bcecill (?:version |v)?2\.1
82 | 0.9 | cecill-b | cecill | \bcecill-b\b
82 | 0.9 | cecill-c | cecill | \bcecill-c\b
80 | 0.8 | cecill | cecill | \bcecill\b
82 | 0.9 | dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung
88 | 1.0 | cc-by-sa-4.0 | sharealike | creative commons attribution sharealike 4\.0 international
88 | 1.0 | cc-by-4.0 | international | creative commons attribution 4\.0 international
88 | 1.0 | cc-by-nc-4.0 | noncommercial | creative commons attribution noncommercial 4\.0 international
88 | 1.0 | cc-by-nd-4.0 | noderivatives | creative commons attribution noderivatives 4\.0 international
88 | 1.0 | cc-by-nc-sa-4.0 | noncommercial | creative commons attribution noncommercial sharealike 4\.0 international
88 | 1.0 | cc-by-nc-nd-4.0 | noncommercial | creative commons attribution noncommercial noderivatives 4\.0 international
88 | 1.0 | cc-by-sa-3.0 | unported | creative commons attribution sharealike 3\.0 unported
88 | 1.0 | cc-by-3.0 | unported | creative commons attribution 3\.0 unported
80 | 0.7 | creative-commons | commons | (?:some rights reserved )?creative commons licen[sc]e
15 | 0.9 | reserved | reproduced | no part of this (?:work|book|publication|site|document) may be reproduced
15 | 0.9 | reserved | retrieval | stored in a retrieval system or transmitted in any form
14 | 0.8 | reserved | reserved | \ball rights? reserved\b
14 | 0.8 | reserved | reservados | todos los derechos reservados
14 | 0.8 | reserved | réservés | tous droits réservés
14 | 0.8 | reserved | vorbehalten | alle rechte vorbehalten
14 | 0.6 | reserved | reserved | some rights reserved
13 | 0.6 | copyright | copyright | \bcopyright\s{0,3}(?:\(c\)|©)?\s{0,3}(?:19|20)\d\d\b
13 | 0.6 | copyright | (c) | \(c\)\s{0,3}(?:\(c\)|©)?\s{0,3}(?:19|20)\d\d\b
13 | 0.6 | copyright | © | ©\s{0,3}(?:\(c\)|©)?\s{0,3}(?:19|20)\d\d\b
12 | 0.8 | public-domain | domain | \b(?:in|into|to) the public domain\b
12 | 0.8 | proprietary | proprietary | \bproprietary and confidential\b
12 | 0.8 | proprietary | confidential | \bconfidential and proprietary\b
12 | 0.8 | proprietary | trade | \btrade secrets? of\b
12 | 0.8 | proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|software|material)
12 | 0.7 | proprietary | internal | \bfor internal use only\b
12 | 0.7 | non-commercial | only | \bfor (?:non[\s-]{0,2}commercial|personal|academic|educational|research) use only\b
12 | 0.7 | non-commercial | commercial | \bmay not be used for commercial purposes\b
12 | 0.7 | non-commercial | commercial | \bno commercial use\b
12 | 0.8 | permissive | permission | \bpermission is hereby granted\b
12 | 0.8 | permissive | permission | \bpermission to use copy (?:and )?modify\b
12 | 0.9 | permissive | redistribution | \bredistribution and use in source and binary forms\b
12 | 0.6 | permissive | freely | \bmay be (?:used|copied|distributed) freely\b
12 | 0.6 | permissive | royalty | \broyalty free\b
12 | 0.6 | attribution | attribution | \bwith (?:proper |appropriate )?attribution\b
12 | 0.5 | no-warranty | warranty | \bprovided as is without warranty\b
12 | 0.5 | no-warranty | warranties | \bwithout warranties or conditions of any kind\b
12 | 0.5 | terms-of-use | terms | \bby using this (?:site|website|service|software) you agree to (?:the|these|our) terms\b
12 | 0.5 | trademark | trademark | \b(?:is|are) (?:a )?(?:registered )?trademarks? of\b
"""


def signatures() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, pattern, keyword, confidence)."""
    rules = []
    for line in SIGNATURES.strip().splitlines():
        priority, sure, label, keyword, pattern = line.split(" | ", 4)
        rules.append((int(priority), label, pattern.replace(" ", SEPARATOR), keyword, float(sure)))
    return rules
