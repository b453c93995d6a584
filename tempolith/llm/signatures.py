"""Signatures of licenses as they stand in files and on pages: label and pattern, one blank between words, A-Z in lower case.

Grants, conditions and disclaimers of the licenses' own texts; headers with versions and "or later" forms; exceptions; SPDX expressions;
translations of the usual notices. Fixed values: the wording is that of the licenses.
"""

from __future__ import annotations

_W = "(?:[^ ]+ )"  # a word

GRANTS = [
    # MIT, X11, ISC and their kin
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", r"to deal in the software without restriction including without limitation the rights"),
    ("mit", r"rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", r"warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-modern", r"the above copyright notice and this permission notice (?:including the next paragraph )shall be included"),
    ("mit-0", r"mit no attribution"),
    ("x11", r"the name of the x consortium shall not be used in advertising"),
    ("x11", r"except as contained in this notice the name" + rf" (?:{_W}){{1,12}}shall not be used in advertising"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", r"the software is provided as is and" + rf" (?:{_W}){{1,6}}disclaims all warranties with regard to this software"),
    ("isc", r"loss of use data or profits whether in an action of contract negligence or other tortious action"),
    ("0bsd", r"zero clause bsd"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd", r"provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear"),
    ("ntp", r"makes no representations about the suitability (?:of )?this software for any purpose"),
    # BSD
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", r"neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse"),
    ("bsd", r"this software is provided by the (?:[^ ]+ ){1,6}and contributors as is"),
    ("bsd", r"any express or implied warranties including but not limited to the implied warranties of merchantability"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd-4-clause", r"this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-patent", r"grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("bsd", r"the views and conclusions contained in the software and documentation are those of the authors"),
    # Apache
    ("apache", r"licensed under the apache license"),
    ("apache", r"you may not use this file except in compliance with the license"),
    ("apache", r"you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("apache", r"unless required by applicable law or agreed to in writing software"),
    ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", r"see the notice file distributed with this work for additional information regarding copyright ownership"),
    ("apache-1", r"this product includes software developed by the apache software foundation"),
    ("apache-1", r"the names apache and apache software foundation must not be used to endorse or promote"),
    ("llvm-exception", r"apache license v2 0 with llvm exceptions"),
    ("llvm-exception", r"as an exception if as a result of your compiling your source code portions of this software are embedded"),
    # GPL
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", r"you can redistribute it and or modify it under the terms of version (?:[^ ]+ )?of the gnu general public license"),
    ("gpl", r"as published by the free software foundation either version (?:[^ ]+ )?of the license or"),
    ("gpl", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", r"you should have received a copy of the gnu general public license along with"),
    ("gpl-2.0", r"gnu general public license (?:as published by the free software foundation )?version 2"),
    ("gpl-2.0", r"under the terms of the gnu general public license version 2 (?:only )?as published by"),
    ("gpl-2.0-or-later", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", r"gnu general public license (?:as published by the free software foundation )?version 3"),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007"),
    ("gpl-3.0-or-later", r"either version 3 of the license or at your option any later version"),
    ("gpl", r"the gnu general public license is a free copyleft license for software"),
    ("gpl", r"this program may be freely redistributed under the terms of the gnu gpl"),
    ("gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom"),
    ("classpath-exception", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("classpath-exception", r"designates? this particular file as subject to the classpath exception"),
    ("gcc-exception", r"under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("autoconf-exception", r"as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script"),
    ("bison-exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("font-exception", r"if you create a document which uses this font and embed this font"),
    ("linking-exception", r"in addition as a special exception" + rf" (?:{_W}){{1,14}}(?:gives? )?permission to link the code"),
    ("syscall-note", r"this copyright does not cover user programs that use kernel services by normal system calls"),
    ("lgpl", r"under the terms of the gnu lesser general public license"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", r"gnu lesser general public license (?:as published by the free software foundation either )?version 2 1"),
    ("lgpl-3.0", r"gnu lesser general public license (?:as published by the free software foundation either )?version 3"),
    ("lgpl", r"under the terms of the gnu library general public license"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl", r"this license the lesser general public license applies to some specially designated software packages"),
    ("agpl", r"under the terms of the gnu affero general public license"),
    ("agpl", r"you should have received a copy of the gnu affero general public license"),
    ("agpl", r"if you modify the program your modified version must prominently offer all users interacting with it remotely"),
    ("agpl", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", r"under the terms of the gnu free documentation license"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts"),
    # Mozilla, Eclipse, CDDL, Microsoft and other weak copyleft
    ("mpl", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("npl", r"the contents of this file are subject to the netscape public license"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-2.0", r"available under the terms of the eclipse public license 2 0 which is available at"),
    ("epl-2.0", r"this source code may also be made available under the following secondary licenses"),
    ("edl", r"available under the terms of the eclipse distribution license"),
    ("cpl", r"made available under the terms of the common public license"),
    ("ipl", r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", r"subject to the terms of the common development and distribution license"),
    ("cddl", r"when distributing covered code include this cddl header in each file"),
    ("ms-pl", r"microsoft public license"),
    ("ms-rl", r"microsoft reciprocal license"),
    ("ms-pl", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("eupl", r"licensed under the eupl"),
    ("eupl", r"licen[sc]ed under the european union public licen[sc]e"),
    ("cecill", r"this software is governed by the cecill (?:b |c )?license under french law"),
    ("cecill", r"ce logiciel est regi par la licence cecill"),
    ("osl", r"licensed under the open software license"),
    ("afl", r"licensed under the academic free license"),
    ("qpl", r"this software is licensed under the terms of the q public license"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("openldap", r"the openldap public license"),
    ("artistic", r"under the same terms as perl itself"),
    ("artistic", r"under the terms of the artistic license"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    # small and special
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", r"the origin of this source code must not be misrepresented"),
    ("libpng", r"the contributing authors and group 42 inc disclaim all warranties"),
    ("boost", r"distributed under the boost software license"),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", r"the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies"),
    ("wtfpl", r"you just do what the fuck you want to"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("json", r"the software shall be used for good not evil"),
    ("psf", r"python software foundation license agreement"),
    ("psf", r"psf is making python available to licensee on an as is basis"),
    ("cnri", r"cnri open source license agreement"),
    ("php", r"this source file is subject to version (?:[^ ]+ ){1,3}of the php license"),
    ("openssl", r"this product includes software developed by the openssl project"),
    ("openssl", r"this product includes cryptographic software written by eric young"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("vim", r"vim is charityware"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("ncsa", r"developed by (?:[^ ]+ ){1,12}university of illinois at urbana champaign"),
    ("ncsa", r"to deal with the software without restriction"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", r"icu license icu 1 8 1 and later"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", r"portions of this software are copyright (?:[^ ]+ ){0,4}the freetype project"),
    ("w3c", r"permission to copy modify and distribute this (?:software|work|document) (?:and its documentation )?with or without modification for any purpose and without fee or royalty"),
    ("w3c", r"w3c software (?:and document )?notice and license"),
    ("upl", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation"),
    ("mulan", r"you can use this software according to the terms and conditions of the mulan psl"),
    ("blueoak", r"blue oak model license"),
    ("ecl", r"licensed under the educational community license"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("lppl", r"this work has the lppl maintenance status"),
    ("ofl", r"licensed under the sil open font license"),
    ("ofl", r"the fonts including any derivative works can be bundled embedded redistributed and or sold with any software"),
    ("ofl", r"with reserved font name"),
    ("ubuntu-font", r"ubuntu font licence"),
    ("bitstream-vera", r"the names bitstream and vera must not be used"),
    # data and content
    ("odbl", r"open database license"),
    ("odbl", r"database contents license"),
    ("odbl", r"made available under the open database license"),
    ("odc-by", r"open data commons attribution license"),
    ("pddl", r"public domain dedication and license"),
    ("ogl", r"contains public sector information licensed under the open government licence"),
    ("ogl", r"open government licence v ?[0-9]"),
    ("cdla", r"community data license agreement"),
    ("cc0", r"waived all copyright and related (?:or|and) neighboring rights"),
    ("cc0", r"dedicated the work to the public domain"),
    ("cc0", r"to the extent possible under law"),
    ("cc0", r"no copyright reserved cc0"),
    ("cc-by", r"this work is licensed under a creative commons attribution (?:[0-9] [0-9] )?(?:[^ ]+ )?license"),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike license"),
    ("cc-by-sa", r"you must distribute your contributions under the same license as the original"),
    ("cc-by-nc", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc", r"some rights reserved (?:under )?creative commons"),
    ("cc", r"this license is acceptable for free cultural works"),
    ("public-domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", r"is in the public domain"),
    ("public-domain", r"public domain dedication"),
    ("public-domain", r"no copyright is claimed in the united states"),
    ("public-domain", r"is a work of the united states government"),
    ("public-domain", r"this file has no copyright assigned and is placed in the public domain"),
    ("public-domain", r"the author disclaims copyright to this source code"),
    ("gutenberg", r"this ebook is for the use of anyone anywhere (?:in the united states )?(?:and most other parts of the world )?at no cost and with almost no restrictions"),
    ("gutenberg", r"you may copy it give it away or re use it under the terms of the project gutenberg"),
    # source available
    ("bsl", r"business source license 1 1"),
    ("bsl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("bsl", r"effective on the change date"),
    ("sspl", r"server side public license"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic", r"elastic license 2 0"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"commons clause license condition"),
    ("commons-clause", r"does not grant to you the right to sell the software"),
    ("polyform", r"polyform (?:noncommercial|strict|shield|free trial|internal use|perimeter|small business) license"),
    ("rail", r"responsible ai license"),
    ("rail", r"open ?rail(?: m)? license"),
    ("llama", r"llama [0-9](?: [0-9])? community license"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"confidential and proprietary"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution)(?: [^ ]+){0,6} is (?:strictly )?prohibited"),
    ("proprietary", r"no part of this (?:publication|work|document|book) may be reproduced"),
    ("proprietary", r"without (?:the )?(?:prior )?(?:express )?written (?:permission|consent) of (?:the )?(?:publisher|author|copyright holder|owner)"),
    ("proprietary", r"this software is the confidential and proprietary information of"),
    ("proprietary", r"reproduction in whole or in part without (?:written )?permission is prohibited"),
    ("proprietary", r"may not be published broadcast rewritten or redistributed"),
    ("proprietary", r"may not be copied reproduced (?:republished )?(?:uploaded )?(?:posted )?(?:transmitted )?or distributed"),
    ("proprietary", r"end user license agreement"),
    ("proprietary", r"for internal use only"),
    ("reserved", r"copyright (?:[^ ]+ ){0,8}all rights reserved"),
    ("reserved", r"(?:no|some) rights reserved"),
    ("reserved", r"tous droits (?:de reproduction )?(?:réservés|reserves)"),
    ("reserved", r"alle rechte vorbehalten"),
    ("reserved", r"todos los derechos reservados"),
    ("reserved", r"todos os direitos reservados"),
    ("reserved", r"tutti i diritti (?:sono )?riservati"),
    ("reserved", r"alle rechten voorbehouden"),
    ("reserved", r"wszelkie prawa (?:zastrzeżone|zastrzezone)"),
    ("reserved", r"(?:в|В)се права защищены"),
    ("non-commercial", r"non commercial (?:use|purposes) only"),
    ("non-commercial", r"noncommercial (?:use|purposes) only"),
    ("non-commercial", r"not for commercial use"),
    ("non-commercial", r"for (?:personal|private|educational|academic|research)(?: [^ ]+){0,4} use only"),
    ("no-derivatives", r"no derivative works (?:are )?(?:allowed|permitted)"),
    ("evaluation", r"for evaluation purposes only"),
    ("evaluation", r"may not be used in production without a (?:commercial )?license"),
    ("permission", r"(?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission"),
    ("copyleft", r"copyleft"),
    ("license-file", r"see (?:the )?(?:accompanying )?(?:file )?(?:license|copying)(?: txt| md)? (?:file )?(?:for|in) (?:more )?(?:details|information|the project root)"),
    ("license-file", r"license that can be found in the license file"),
    ("license-file", r"governed by a bsd style license"),
    ("dual", r"dual licensed under"),
    ("dual", r"at your option under (?:either )?(?:the )?(?:terms of )?(?:apache|mit|gpl|lgpl|mpl|bsd)"),
    ("dual", r"either license at your option"),
]

#: SPDX short forms behind the identifier line, as the words that they come to.
SPDX = [
    ("mit", r"mit"), ("mit-0", r"mit 0"), ("apache", r"apache [12] [01]"), ("bsd", r"bsd [1234] clause"), ("0bsd", r"0bsd"), ("isc", r"isc"), ("zlib", r"zlib"), ("boost", r"bsl 1 0"), ("unlicense", r"unlicense"),
    ("gpl-2.0", r"gpl 2 0(?: only)?"), ("gpl-2.0-or-later", r"gpl 2 0 or later"), ("gpl-3.0", r"gpl 3 0(?: only)?"), ("gpl-3.0-or-later", r"gpl 3 0 or later"), ("lgpl-2.1", r"lgpl 2 [01](?: only| or later)?"), ("lgpl-3.0", r"lgpl 3 0(?: only| or later)?"),
    ("agpl", r"agpl [13] 0(?: only| or later)?"), ("mpl", r"mpl [12] [01]"), ("epl", r"epl [12] 0"), ("cddl", r"cddl 1 [01]"), ("eupl", r"eupl 1 [012]"), ("cc0", r"cc0 1 0"), ("cc-by", r"cc by [1234] [05]"), ("cc-by-sa", r"cc by sa [1234] [05]"),
    ("cc-by-nc", r"cc by nc [1234] [05]"), ("cc-by-nd", r"cc by nd [1234] [05]"), ("cc-by-nc-sa", r"cc by nc sa [1234] [05]"), ("cc-by-nc-nd", r"cc by nc nd [1234] [05]"), ("ofl", r"ofl 1 [01]"), ("odbl", r"odbl 1 0"), ("artistic", r"artistic [12] 0"),
    ("psf", r"psf 2 0"), ("php", r"php 3 0[01]?"), ("postgresql", r"postgresql"), ("ncsa", r"ncsa"), ("wtfpl", r"wtfpl"), ("mulan", r"mulanpsl [12] 0"), ("upl", r"upl 1 0"), ("elastic", r"elastic 2 0"), ("sspl", r"sspl 1 0"), ("bsl", r"busl 1 1"),
    ("classpath-exception", r"gpl 2 0(?: only| or later)? with classpath exception 2 0"), ("llvm-exception", r"apache 2 0 with llvm exception"), ("syscall-note", r"gpl 2 0(?: only| or later)? with linux syscall note"), ("proprietary", r"licenseref (?:proprietary|commercial)"),
]

#: Labels of SPDX forms that hold other forms.
COMPOSED = {"classpath-exception", "llvm-exception", "syscall-note"}
