"""License scan by ordered signature rules. Built-in functions only.

A text is folded (A-Z) and reduced to its words ([0-9a-z] and all beyond ASCII), joined by single spaces. Texts without any
keyword of the rules are done. For the others, rules are gated by their own keywords; each gated rule's regex gives
intervals. Rules have priorities: an interval that lies inside one of higher priority, or inside a longer one of the same
priority, or has the same place as an earlier rule's, is suppressed. The labels of what is left are the scan's; base phrases
are reported whatever else covers them.

Defined results: null text is empty. Rows without doc_id are scanned too; repeated rows each get their result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import folded
from .spans import literal, running, spans

# Phrases of the contract and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: label, keywords (any of them, by |, opens the rule's gate), name as a regex over normalised words, words of its SPDX identifier
NAMES = [
    ("gpl-1.0", "general public", r"gnu general public licen[cs]e (?:version 1|v1)(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general public", r"gnu general public licen[cs]e (?:version 2|v2)(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general public", r"gnu general public licen[cs]e (?:version 3|v3)(?: 0)?", "gpl 3 0"),
    ("lgpl-2.0", "library general public", r"gnu library general public licen[cs]e(?: (?:version 2|v2)(?: 0)?)?", "lgpl 2 0"),
    ("lgpl-2.1", "lesser general public", r"gnu lesser general public licen[cs]e (?:version 2 1|v2 1)", "lgpl 2 1"),
    ("lgpl-3.0", "lesser general public", r"gnu lesser general public licen[cs]e (?:version 3|v3)(?: 0)?", "lgpl 3 0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version 3|v3)(?: 0)?)?", "agpl 3 0"),
    ("gfdl", "free documentation", r"gnu free documentation licen[cs]e(?: version 1 [123])?", "gfdl 1 3"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?2 0", "apache 2 0"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("x11", "x11", r"x11 licen[cs]e", "x11"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[cs]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[cs]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e", "bsd 4 clause"),
    ("0bsd", "0bsd|zero clause bsd|bsd zero clause", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", "0bsd"),
    ("isc", "isc", r"isc licen[cs]e", "isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e", "libpng"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v)?2 0", "mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?1 0", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v)?2 0", "epl 2 0"),
    ("cddl-1.0", "cddl", r"cddl (?:version |v)?1 0", "cddl 1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e(?: (?:version |v)?1 [01])?", "cddl 1 1"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: (?:version |v)?1 0)?", "cpl 1 0"),
    ("epl-eu", "european union", r"european union public licen[cs]e(?: (?:version |v)?1 [0-2])?", "eupl 1 2"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:version |v)?1 0", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v)?2 0", "artistic 2 0"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version |v)?1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl|do what the fuck", r"(?:wtfpl|do what the fuck you want to public licen[cs]e)", "wtfpl"),
    ("python-2.0", "python software", r"python software foundation licen[cs]e(?: (?:version |v)?2)?", "python 2 0"),
    ("php-3.01", "php", r"php licen[cs]e(?: (?:version |v)?3 01)?", "php 3 01"),
    ("ruby", "ruby", r"ruby licen[cs]e", "ruby"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 [01])?", "ofl 1 1"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: (?:version |v)?3 0)?", "osl 3 0"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: (?:version |v)?3 0)?", "afl 3 0"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", "ms rl"),
    ("apsl-2.0", "apple public", r"apple public source licen[cs]e(?: (?:version |v)?2 0)?", "apsl 2 0"),
    ("ibm-pl", "ibm public", r"ibm public licen[cs]e(?: (?:version |v)?1 0)?", "ipl 1 0"),
    ("intel", "intel open", r"intel open source licen[cs]e", "intel"),
    ("qpl-1.0", "q public", r"q public licen[cs]e(?: (?:version |v)?1 0)?", "qpl 1 0"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", "sleepycat"),
    ("vim", "vim", r"vim licen[cs]e", "vim"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", "w3c"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: (?:version |v)?2 [01])?", "zpl 2 1"),
    ("lppl-1.3", "latex project", r"latex project public licen[cs]e(?: (?:version |v)?1 3[ac]?)?", "lppl 1 3c"),
    ("odbl-1.0", "open database", r"open database licen[cs]e(?: (?:version |v)?1 0)?", "odbl 1 0"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", "pddl 1 0"),
    ("odc-by-1.0", "attribution", r"open data commons attribution licen[cs]e", "odc by 1 0"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-sa", "share", r"creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa 4 0"),
    ("cc-by-nc", "commercial", r"creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc 4 0"),
    ("cc-by-nd", "deriv", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?", "cc by nd 4 0"),
    ("cc-by-nc-sa", "commercial", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "commercial", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?", "cc by nc nd 4 0"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution (?:4 0|international)", "cc by 4 0"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?: (?:version |v)?1)?", "sspl 1 0"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?: (?:version |v)?1 1)?", "busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:version |v)?2 0)?", "elastic 2 0"),
    ("blueoak-1.0", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?", "blueoak 1 0 0"),
    ("mulan-2.0", "mulan", r"mulan (?:permissive software|psl) (?:licen[cs]e )?v2", "mulanpsl 2 0"),
]

ENDORSE = "may be used to endorse or promote products derived from this software"
#: label, priority, keywords, regex: texts and notices. The holder of a BSD text is as long as it is; the loop is possessive, so it takes no stack.
TEXTS = [
    ("mit", 90, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 40, "mit", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[cs]e"),
    ("bsd", 80, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 90, "endorse or promote", rf"neither the name of (?:(?!neither the name of | {ENDORSE} ).)++ {ENDORSE}"),
    ("bsd-4-clause", 90, "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("isc", 90, "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", 80, "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2.0-or-later", 95, "either version 2", r"gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", 95, "either version 3", r"gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or (?:at your option )?any later version"),
    ("lgpl", 80, "lesser general public", r"gnu lesser general public licen[cs]e"),
    ("gpl", 30, "general public", r"gnu general public licen[cs]e"),
    ("apache-2.0", 90, "apache", r"licensed under the apache licen[cs]e version 2 0(?: the licen[cs]e you may not use this file except in compliance with the licen[cs]e)?"),
    ("apache", 30, "apache", r"apache licen[cs]e"),
    ("mpl-2.0", 90, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("zlib", 90, "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", 90, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 50, "public domain", r"(?:released|dedicated|placed) (?:in)?to the public domain"),
    ("public-domain", 20, "public domain", r"public domain"),
    ("cc-by", 40, "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", 60, "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nc", 60, "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", 60, "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", 70, "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", 70, "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", 50, "creative commons", r"creative commons attribution"),
    ("boost", 80, "boost", r"distributed under the boost software licen[cs]e version 1 0"),
    ("proprietary", 60, "rights reserved", r"(?:confidential and proprietary )?all rights reserved"),
    ("proprietary", 60, "proprietary", r"(?:this (?:file|software|document) is )?proprietary (?:and confidential|software|information)"),
    ("no-redistribution", 60, "without permission|without prior permission|without written permission|without prior written permission", r"(?:may not|must not|not to) be (?:copied|reproduced|redistributed|distributed) (?:in any form )?without (?:prior )?(?:written )?permission"),
    ("warranty-disclaimer", 10, "warrant", r"without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
    ("copyright", 10, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("see-license", 5, "licen|copying", r"see (?:the )?(?:file )?(?:licen[cs]e|copying)(?: file| txt| md)?(?: for (?:more )?details)?"),
]


#: label, priority, keywords, regex: further sentences of license texts and notices, and names without other templates.
MORE = [
    ("apache-2.0", 85, "each contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", 85, "apache org licenses", r"apache org licenses licen[cs]e 2 0"),
    ("apache-2.0", 75, "distributed on an as is basis", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-1.1", 85, "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("mit", 85, "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", 15, "merchantability", r"without warranty of any kind(?: either)? express(?:ed)? or implied including but not limited to the (?:implied )?warranties of merchantability"),
    ("bsd", 75, "source code must retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 75, "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 70, "contributors as is", r"this software is provided by the (?:copyright holders?|regents|authors?) and contributors as is"),
    ("gpl", 85, "verbatim copies of this licen", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("gpl", 75, "general public", r"you should have received a copy of the gnu general public licen[cs]e along with"),
    ("gpl-2.0-only", 95, "version 2 only", r"gnu general public licen[cs]e version 2 only"),
    ("gpl-3.0-only", 95, "version 3 only", r"gnu general public licen[cs]e version 3 only"),
    ("gpl-classpath", 96, "classpath exception", r"(?:gnu )?classpath exception"),
    ("gpl-linking", 96, "permission to link", r"as a special exception .{0,80}?permission to link"),
    ("lgpl", 85, "this library is free software", r"this library is free software you can redistribute it and or modify it"),
    ("lgpl-2.1-or-later", 95, "either version 2 1", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or (?:at your option )?any later version"),
    ("lgpl-2.0-or-later", 95, "library general public", r"gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e"),
    ("agpl-3.0", 85, "remotely through a computer network", r"users interacting with it remotely through a computer network"),
    ("agpl-3.0", 96, "affero", r"affero general public licen[cs]e as published by the free software foundation"),
    ("gfdl", 90, "free documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", 60, "invariant sections", r"with (?:no|the) invariant sections"),
    ("mpl-1.1", 90, "mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-2.0", 90, "copy of the mpl", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-2.0-no-copyleft", 92, "incompatible with secondary licen", r"incompatible with secondary licen[cs]es"),
    ("epl-1.0", 90, "eclipse", r"made available under the terms of the eclipse public licen[cs]e v ?1 0"),
    ("epl-2.0", 90, "eclipse", r"made available under the terms of the eclipse public licen[cs]e v ?2 0"),
    ("edl-1.0", 80, "eclipse distribution", r"eclipse distribution licen[cs]e(?: v ?1 0)?"),
    ("cpl-1.0", 90, "common public", r"made available under the terms of the common public licen[cs]e"),
    ("cddl-1.0", 90, "common development", r"subject to the terms of the common development and distribution licen[cs]e"),
    ("artistic", 50, "artistic", r"artistic licen[cs]e"),
    ("bsl-1.0", 90, "person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib", 85, "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 85, "origin of this software", r"the origin of this software must not be misrepresented"),
    ("unlicense", 85, "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 80, "unlicense org", r"refer to https? (?:www )?unlicense org"),
    ("cc0-1.0", 90, "waived all copyright", r"waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 90, "publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", 90, "publicdomain mark", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by", 85, "org licenses by", r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", 85, "org licenses by", r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", 85, "org licenses by", r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", 85, "org licenses by", r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", 85, "org licenses by", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 85, "org licenses by", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("openssl", 85, "openssl project", r"this product includes software developed by the openssl project"),
    ("ssleay", 85, "eric young", r"this product includes cryptographic software written by eric young"),
    ("php-3.01", 85, "php software", r"this product includes php software(?: freely available)?"),
    ("python-2.0", 85, "python available to licensee", r"psf is making python available to licensee"),
    ("python-cnri", 85, "cnri", r"cnri (?:open source )?licen[cs]e agreement"),
    ("postgresql", 90, "without a written agreement", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("x11", 85, "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("hpnd", 70, "permission to use copy modify and distribute", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd-sell", 72, "distribute and sell", r"permission to use copy modify distribute and sell this software and its documentation for any purpose"),
    ("ncsa", 85, "deal with the software", r"to deal with the software without restriction"),
    ("curl", 80, "daniel stenberg", r"copyright .{0,20}?daniel stenberg"),
    ("w3c", 85, "licensee agree", r"by obtaining using and or copying this work you the licensee agree"),
    ("unicode", 85, "unicode inc", r"unicode inc licen[cs]e agreement"),
    ("ofl-1.1", 90, "font software", r"this font software is licensed under the sil open font licen[cs]e"),
    ("ofl-1.1", 60, "reserved font name", r"with reserved font names?"),
    ("ms-pl", 70, "governs use of the accompanying", r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("odbl-1.0", 85, "open database", r"made available under the open database licen[cs]e"),
    ("json", 90, "for good not evil", r"the software shall be used for good not evil"),
    ("beerware", 85, "do whatever you want with this stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", 70, "beer", r"beer ?ware licen[cs]e"),
    ("ijg", 85, "independent jpeg group", r"based in part on the work of the independent jpeg group"),
    ("ftl", 85, "freetype", r"the freetype (?:project licen[cs]e|licen[cs]e)"),
    ("bzip2", 80, "julian r seward", r"copyright .{0,20}?julian r seward"),
    ("icu", 70, "icu", r"icu licen[cs]e"),
    ("sleepycat", 85, "complete source code", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("vim", 80, "charityware", r"vim is charityware"),
    ("ruby", 80, "give away verbatim copies", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("tcl", 85, "authors hereby grant permission", r"the authors hereby grant permission to use copy modify distribute and licen[cs]e this software"),
    ("info-zip", 75, "info zip", r"info zip licen[cs]e"),
    ("zend-2.0", 75, "zend", r"zend (?:engine )?licen[cs]e"),
    ("nist-pd", 80, "national institute of standards", r"developed at the national institute of standards and technology by employees of the federal government"),
    ("cecill-2.1", 75, "cecill", r"cecill (?:free software )?licen[cs]e(?: agreement)?"),
    ("cecill-b", 78, "cecill b", r"cecill b (?:free software )?licen[cs]e"),
    ("cecill-c", 78, "cecill c", r"cecill c (?:free software )?licen[cs]e"),
    ("eupl", 70, "eupl", r"licensed under the eupl"),
    ("osl-3.0", 85, "open software", r"licensed under the open software licen[cs]e version 3 0"),
    ("afl-3.0", 85, "academic free", r"licensed under the academic free licen[cs]e version 3 0"),
    ("apsl-2.0", 85, "apple public source", r"subject to the apple public source licen[cs]e"),
    ("netscape-1.1", 75, "netscape public", r"netscape public licen[cs]e(?: (?:version |v)?1 [01])?"),
    ("nasa-1.3", 75, "nasa open source", r"nasa open source agreement(?: (?:version |v)?1 3)?"),
    ("sun-public", 75, "sun public", r"sun public licen[cs]e(?: (?:version |v)?1 0)?"),
    ("sissl", 75, "sun industry standards", r"sun industry standards source licen[cs]e"),
    ("rpl-1.5", 75, "reciprocal public", r"reciprocal public licen[cs]e(?: (?:version )?1 [15])?"),
    ("realnetworks", 75, "realnetworks", r"realnetworks public source licen[cs]e"),
    ("lucent-1.02", 75, "lucent public", r"lucent public licen[cs]e(?: (?:version )?1 0[02]?)?"),
    ("nethack", 75, "nethack", r"nethack general public licen[cs]e"),
    ("fair", 55, "fair licen", r"the fair licen[cs]e"),
    ("watcom-1.0", 75, "open watcom", r"sybase open watcom public licen[cs]e"),
    ("wxwindows", 75, "wxwindows", r"wxwindows library licen[cs]e"),
    ("zimbra-1.3", 75, "zimbra", r"zimbra public licen[cs]e"),
    ("yahoo-1.1", 75, "yahoo", r"yahoo public licen[cs]e"),
    ("erlang-1.1", 75, "erlang", r"erlang public licen[cs]e"),
    ("interbase-1.0", 75, "interbase", r"interbase public licen[cs]e"),
    ("aladdin", 75, "aladdin", r"aladdin free public licen[cs]e"),
    ("open-publication", 75, "open publication", r"open publication licen[cs]e"),
    ("free-art-1.3", 75, "free art", r"free art licen[cs]e(?: 1 3)?"),
    ("gust-font", 75, "gust font", r"gust font (?:nosource )?licen[cs]e"),
    ("bitstream-vera", 75, "bitstream vera", r"bitstream vera (?:fonts? )?(?:copyright|licen[cs]e)"),
    ("ubuntu-font", 75, "ubuntu font", r"ubuntu font licen[cs]e(?: (?:version )?1 0)?"),
    ("arphic-1999", 75, "arphic", r"arphic public licen[cs]e"),
    ("ipa-font", 75, "ipa font", r"ipa font licen[cs]e(?: agreement)?"),
    ("commons-clause", 92, "commons clause", r"commons clause (?:licen[cs]e )?(?:condition|restriction)"),
    ("polyform-noncommercial", 75, "polyform noncommercial", r"polyform noncommercial licen[cs]e"),
    ("polyform-small-business", 75, "polyform small business", r"polyform small business licen[cs]e"),
    ("confluent-community", 75, "confluent community", r"confluent community licen[cs]e"),
    ("rsal", 75, "source available", r"source available licen[cs]e"),
    ("timescale", 75, "timescale", r"timescale licen[cs]e"),
    ("fsl-1.1", 75, "functional source", r"functional source licen[cs]e"),
    ("prosperity", 75, "prosperity public", r"prosperity public licen[cs]e"),
    ("parity", 75, "parity public", r"parity public licen[cs]e"),
    ("hippocratic", 75, "hippocratic", r"hippocratic licen[cs]e"),
    ("openrail-m", 75, "rail", r"(?:creativeml |bigcode |bigscience )?open ?rail m(?: licen[cs]e)?"),
    ("llama-community", 75, "community licen", r"llama (?:[1-9] )?(?:[0-9] )?community licen[cs]e"),
    ("gemma-terms", 75, "gemma terms", r"gemma terms of use"),
    ("non-commercial", 55, "commercial", r"(?:for )?non ?commercial (?:use|purposes?) only"),
    ("evaluation-only", 55, "evaluation", r"for evaluation (?:use|purposes?) only"),
    ("no-redistribution", 60, "not for redistribution", r"not for redistribution"),
    ("no-derivatives", 55, "derivative works", r"(?:may not|must not|shall not) (?:create|make|prepare) derivative works"),
    ("trade-secret", 55, "trade secret", r"(?:contains|are|is) (?:confidential )?trade secrets?"),
    ("eula", 60, "end user licen", r"end user licen[cs]e agreement"),
    ("eula", 60, "you agree to be bound", r"you agree to be bound by the terms of this (?:agreement|licen[cs]e)"),
    ("eula", 55, "reverse engineer", r"reverse engineer decompile or disassemble"),
    ("patent-grant", 30, "patent licen", r"royalty free (?:irrevocable )?patent licen[cs]e"),
    ("dual-licensed", 40, "dual licen", r"dual licen[cs]ed"),
    ("reuse", 40, "reprinted with permission", r"reprinted with permission"),
    ("dco", 20, "certificate of origin", r"developer certificate of origin"),
    ("cla", 20, "contributor licen", r"contributor licen[cs]e agreement"),
]


def rules() -> list[tuple[str, int, str, str]]:
    """All rules by descending priority: label, priority, keywords, regex. A name gives rules for its mention, its grant, its reference and its identifier."""
    out = TEXTS + MORE
    for label, keyword, name, ident in NAMES:
        out.append((label, 60, keyword, name))
        out.append((label, 70, keyword, rf"(?:licensed|released|distributed|available|covered|published) under (?:the )?(?:terms of (?:the )?)?{name}"))
        out.append((label, 65, keyword, rf"(?:subject to|governed by|terms of|conditions of) the {name}"))
        out.append((label, 90, "spdx", rf"spdx licen[cs]e identifier {ident}(?: only| or later)?"))
    return sorted(out, key=lambda r: -r[1])


#: Parts of words, one of which is in every match of every rule: a text without them is done. The tests try each alternative of each rule.
STEMS = "licen spdx copyright domain propriet reserved warrant permi endorse acknowledg misrepresented bsd wtfpl mulan cddl cc0 commons attribution copying invariant consortium stuff jpeg redistribut charityware federal agreement rail gemma commercial evaluation derivative secret reverse incompatible evil software certificate classpath distributed perpetual remotely publicdomain".split()
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrase and rules of Creative Commons by their short name, which no stem stands for.
CC = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
GATE = "|".join([*STEMS, CC])
HIT = "struct<label: string, priority: int, level: int, rank: int, start: bigint, stop: bigint>"


def _holds(word: str) -> str:
    return f"contains(norm, '{word}')"


def _matching() -> str:
    """SQL for the rules that match norm, as array of structs: rules that share a keyword are tried only where it is, all of them by fixed patterns."""
    groups: dict[str, list[str]] = {}
    levels = sorted({r[1] for r in rules()}, reverse=True)
    for k, (label, p, words, re) in enumerate(rules()):
        pattern = literal(f"(?<= ){re}(?= )")
        groups.setdefault(words, []).append(f"if(norm rlike {pattern}, named_struct('rank', {k}, 'label', '{label}', 'priority', {p}, 'level', {levels.index(p)}, 're', {pattern}), null)")
    some = [f"if({' or '.join(map(_holds, words.split('|')))}, array({', '.join(each)}), null)" for words, each in groups.items()]
    return f"filter(flatten(filter(array({', '.join(some)}), g -> g is not null)), r -> r is not null)"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places array<struct<phrase, word>> of base phrases, found array<struct<label, priority, start, stop>> of surviving rules, labels, score.

    start and stop count characters of the normalised text. score is the share of a full certainty of 100 that the strongest rule has.
    """
    low = folded(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", low.alias("low"))
    rows = rows.withColumn("n_words", F.regexp_count("low", F.lit(WORDS)).cast("long"))
    # texts in which no rule can match are not normalised
    open_ = " or ".join(f"contains(low, '{x}')" for x in STEMS) + f" or low rlike {literal(CC)}"
    rows = rows.withColumn("norm", F.expr(f"case when {open_} then concat(' ', array_join(regexp_extract_all(low, {literal(WORDS)}, 0), ' '), ' ') end")).drop("low")
    base = literal("(?<= )(?:" + "|".join(p for p, _ in BASE) + ")(?= )")
    # a place is the number of words, and so of blanks, before it
    blanks = lambda x: f"coalesce(length({x}) - length(replace({x}, ' ', '')), 0)"
    before = f"a.at + {blanks('x.`0`')}"
    place = running(f"arrays_zip(split(norm, {base}, -1), regexp_extract_all(norm, {base}, 0))", "struct<phrase: string, word: bigint>", f"{before} + {blanks('x.`1`')}", "x.`1` is not null", f"named_struct('phrase', x.`1`, 'word', cast({before} - 1 as bigint))")
    rows = rows.withColumn("places", F.expr(f"case when norm is not null then {place} else cast(array() as array<struct<phrase: string, word: bigint>>) end"))
    rows = rows.withColumn("rules", F.expr(f"case when norm is not null then {_matching()} end"))
    hits = f"flatten(transform(rules, r -> transform({spans('norm', 'r.re')}, s -> named_struct('label', r.label, 'priority', r.priority, 'level', r.level, 'rank', r.rank, 'start', s.start, 'stop', s.stop))))"
    rows = rows.withColumn("hits", F.expr(f"case when norm is not null then {hits} else cast(array() as array<{HIT}>) end"))
    # a pass from left to right, longer ones first: level by level, how far the intervals so far reach; who ends within one of a level as high is inside it
    ordered = "transform(array_sort(transform(hits, h -> named_struct('start', h.start, 'less', -h.stop, 'rank', h.rank, 'h', h))), o -> o.h)"
    zero = f"array_repeat(-1L, {len({r[1] for r in rules()})})"
    found = running(ordered, "struct<label: string, priority: int, start: bigint, stop: bigint>", "transform(a.at, (m, i) -> if(i = x.level, greatest(m, x.stop), m))", "not exists(slice(a.at, 1, x.level + 1), m -> m >= x.stop)", "named_struct('label', x.label, 'priority', x.priority, 'start', x.start, 'stop', x.stop)", zero, "array<bigint>")
    rows = rows.withColumn("found", F.expr(found))
    names = F.create_map(*(F.lit(x) for pair in BASE for x in pair))
    rows = rows.withColumn("base_labels", F.array_sort(F.array_distinct(F.transform("places", lambda p: names[p["phrase"]]))))
    rows = rows.withColumn("labels", F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("found", lambda h: h["label"])))))
    score = F.coalesce(F.array_max(F.transform("found", lambda h: h["priority"])) / 100, F.lit(0.0)).cast("double")
    return rows.select("doc_id", "n_words", "places", "found", "base_labels", "labels", score.alias("score"))
