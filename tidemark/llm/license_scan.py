"""License scan with ordered signature rules, as column expressions only.

A text is lower-cased (A-Z), its words are joined by single spaces, and hundreds of hand-written signatures are matched
on that. Two gates keep this cheap: a text without any anchor is not looked at further, and a rule is matched only
where its keyword occurs. Detections that overlap are resolved in one sweep over the sorted intervals: a detection goes
when another of the same or a higher priority contains it; of equal intervals the higher priority, then the earlier rule
stays. All of this happens within the row, so nothing is shuffled and no key can be hot.

Main path native: only DataFrame and SQL functions.

Contract: null texts count as empty (no words, no labels, score 0); rows may repeat and are scanned each on its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_of, appended, let, nothing

#: Characters that separate words: all of ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases, found as consecutive words, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: One of these occurs in every match, so texts without any are done. A rule's keyword occurs in all of its matches.
ANCHORS = (
    "licen", "attribution", "spdx", "cc by", "cc0", "creative commons", "creativecommons", "public domain", "gpl", "bsd", "rights reserved",
    "permission", "warrant", "redistribut", "copyright", "liab", "modif", "freely", "contributors", "remotely", "invariant sections",
    "eclipse org", "cddl", "a package may be", "commercial purposes", "font name", "what the fuck", "retain this notice", "openssl",
    "software foundation", "not evil", "jpeg group", "use grant", "managed service", "datenlizenz", "unauthorized copying", "proprietary",
    "trade secret", "terms of use", "commercial use", "for academic", "misrepresented", "may not be removed", "of the mpl", "advertising", "without restriction",
)

# Names are matched on normalised text: no case, no punctuation, "2.0" is "2 0".
#: label, keyword of its name, signature of its name, signature of its SPDX identifier
NAMES = (
    ("mit", "mit license", r"(?:the )?(?:expat )?mit license", r"mit"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?", r"mit 0"),
    ("apache-1.0", "apache", r"apache (?:software )?license(?: version)? 1 0", r"apache 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license(?: version)? 1 1", r"apache 1 1"),
    ("apache-2", "apache", r"apache (?:software )?license(?: version| v)? ?2(?: 0)?", r"apache 2 0"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd license|bsd (?:2|two) clause(?: license)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:modified|new|revised|3 clause|three clause) bsd license|bsd (?:3|three) clause(?: license)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4 clause|four clause) bsd license|bsd (?:4|four) clause(?: license)?", r"bsd 4 clause"),
    ("bsd-0-clause", "bsd", r"(?:zero clause|0 clause) bsd(?: license)?|bsd (?:0|zero) clause(?: license)?", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? license", r"bsd"),
    ("isc", "isc license", r"isc license", r"isc"),
    ("zlib", "licen", r"zlib(?: libpng)? license", r"zlib"),
    ("libpng", "libpng license", r"libpng license(?: version 2)?", r"libpng(?: 2 0)?"),
    ("boost-1.0", "boost software license", r"boost software license(?: version)?(?: 1 0)?", r"bsl 1 0"),
    ("bsl-1.1", "business source license", r"business source license(?: version)?(?: 1 1)?", r"busl 1 1"),
    ("gpl-1", "general public license", r"(?:gnu )?general public license(?: version| v)? 1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2+", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?(?: of the license)? or (?:at your option )?any later version", r"gpl 2 0 or later"),
    ("gpl-2", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: version| v)? 2(?: 0)?", r"gpl 2 0(?: only)?"),
    ("gpl-3+", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: of the license)? or (?:at your option )?any later version", r"gpl 3 0 or later"),
    ("gpl-3", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: version| v)? 3(?: 0)?", r"gpl 3 0(?: only)?"),
    ("gpl", "general public license", r"(?:gnu )?general public license", r"gpl"),
    ("lgpl-2", "general public license", r"(?:gnu )?library general public license(?: version| v)? ?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "general public license", r"(?:gnu )?lesser general public license(?: version| v)? ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "general public license", r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "general public license", r"(?:gnu )?(?:lesser|library) general public license", r"lgpl"),
    ("agpl-3", "general public license", r"(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "general public license", r"(?:gnu )?affero general public license", r"agpl"),
    ("gfdl-1.1", "documentation license", r"(?:gnu )?free documentation license(?: version)? 1 1", r"gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", "documentation license", r"(?:gnu )?free documentation license(?: version)? 1 2", r"gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "documentation license", r"(?:gnu )?free documentation license(?: version)? 1 3", r"gfdl 1 3(?: only| or later)?"),
    ("gfdl", "documentation license", r"(?:gnu )?free documentation license", r"gfdl"),
    ("mpl-1.0", "public license", r"mozilla public license(?: version| v)? ?1 0", r"mpl 1 0"),
    ("mpl-1.1", "public license", r"mozilla public license(?: version| v)? ?1 1", r"mpl 1 1"),
    ("mpl-2", "public license", r"mozilla public license(?: version| v)? ?2(?: 0)?", r"mpl 2 0"),
    ("epl-1", "public license", r"eclipse public license(?: version| v)? ?1(?: 0)?", r"epl 1 0"),
    ("epl-2", "public license", r"eclipse public license(?: version| v)? ?2(?: 0)?", r"epl 2 0"),
    ("cpl-1", "public license", r"common public license(?: version| v)? ?1(?: 0)?", r"cpl 1 0"),
    ("ipl-1", "public license", r"ibm public license(?: version| v)? ?1(?: 0)?", r"ipl 1 0"),
    ("cddl-1.0", "distribution license", r"common development and distribution license(?: version)?(?: 1 0)?", r"cddl 1 0"),
    ("cddl-1.1", "distribution license", r"common development and distribution license(?: version)? 1 1", r"cddl 1 1"),
    ("eupl-1.1", "public licence", r"european union public licence(?: v| version)? ?1 1", r"eupl 1 1"),
    ("eupl-1.2", "public licence", r"european union public licence(?: v| version)? ?1 2", r"eupl 1 2"),
    ("artistic-1", "artistic license", r"artistic license(?: version)? ?1(?: 0)?", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2", "artistic license", r"artistic license(?: version)? ?2(?: 0)?", r"artistic 2 0"),
    ("psf-2", "python software foundation license", r"python software foundation license(?: version)?(?: 2)?", r"psf 2 0"),
    ("python-2", "python license", r"python license(?: version)?(?: 2 0)?", r"python 2 0"),
    ("php-3", "php license", r"php license(?: version)? ?3 0", r"php 3 0"),
    ("php-3.01", "php license", r"php license(?: version)? ?3 01", r"php 3 01"),
    ("ruby", "ruby license", r"ruby license", r"ruby"),
    ("wtfpl", "you want to public license", r"do what the fuck you want to public license(?: version 2)?", r"wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc0-1", "creative commons", r"creative commons zero(?: license)?(?: v?1 0)?(?: universal)?", None),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?", r"cc by [1-4] [05]"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]"),
    ("cc-by", "creative commons", r"creative commons attribution(?: license)?(?: [1-4] [05])?(?: international| unported| generic)?", None),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: license)?(?: [1-4] [05])?(?: international| unported| generic)?", None),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: license)?(?: [1-4] [05])?(?: international| unported| generic)?", None),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: license)?(?: [1-4] [05])?(?: international| unported| generic)?", None),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: license)?(?: [1-4] [05])?(?: international| unported)?", None),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: license)?(?: [1-4] [05])?(?: international| unported)?", None),
    ("odbl-1", "open database license", r"(?:open data commons )?open database license(?: v?1 0)?", r"odbl 1 0"),
    ("odc-by-1", "attribution license", r"open data commons attribution license(?: v?1 0)?", r"odc by 1 0"),
    ("pddl-1", "public domain", r"(?:open data commons )?public domain dedication and licen[cs]e(?: v?1 0)?", r"pddl 1 0"),
    ("ofl-1.1", "open font license", r"(?:sil )?open font license(?: version)?(?: 1 1)?", r"ofl 1 1"),
    ("afl-3", "academic free license", r"academic free license(?: version| v)?(?: 3 0)?", r"afl 3 0"),
    ("osl-3", "open software license", r"open software license(?: version| v)?(?: 3 0)?", r"osl 3 0"),
    ("ms-pl", "microsoft public license", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license", r"ms rl"),
    ("ncsa", "open source license", r"university of illinois ncsa open source license", r"ncsa"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e", r"postgresql"),
    ("openssl", "openssl license", r"openssl license", r"openssl"),
    ("sspl-1", "server side public license", r"server side public license(?: version| v)?(?: 1)?", r"sspl 1 0"),
    ("elastic-2", "elastic license", r"elastic license(?: version)?(?: 2 0)?", r"elastic 2 0"),
    ("mulan-psl-2", "mulan permissive software license", r"mulan permissive software license(?: version| v)? ?2", r"mulanpsl 2 0"),
    ("upl-1", "universal permissive license", r"universal permissive license(?: version| v)?(?: 1 0)?", r"upl 1 0"),
    ("open-gov-3", "open government licence", r"open government licence(?: version| v)?(?: 3 0)?", r"ogl uk 3 0"),
    ("x11", "x11 license", r"x11 license", r"x11"),
    ("curl", "curl license", r"curl license", r"curl"),
    ("beerware", "beer ware license", r"beer ware license(?: revision 42)?", r"beerware"),
)

#: How a name may stand in a text: a template and its priority. The bare name comes last.
FORMS = (
    (r"spdx license identifier {spdx}", 3),
    (r"(?:licensed|released|distributed|available|provided|published|covered|shared) (?:under|by|with) (?:(?:the|a|an) )?(?:terms of (?:the )?)?(?:{name})", 2),
    (r"(?:{name})", 1),
)

#: Lines of license texts, warranty notices and file headers: label, keyword, signature, priority.
NOTICES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 2),
    ("mit", "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 2),
    ("mit", "the above copyright notice and this permission notice", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 2),
    ("mit", "authors or copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 2),
    ("mit", "see license mit", r"see license mit(?: txt| md)? for(?: more)? details", 1),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising", 2),
    ("ncsa", "deal with the software", r"to deal with the software without restriction including without limitation the rights", 2),
    ("isc", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 2),
    ("isc", "the author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software", 2),
    ("bsd-0-clause", "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1),
    ("bsd", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 2),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 2),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 2),
    ("bsd-3-clause", "endorse or promote products", r"neither the name of (?:the )?(?:copyright holder|university|author|company|organization) nor the names of its contributors may be used to endorse or promote products", 2),
    ("bsd-3-clause", "nor the names of its contributors", r"neither the name of the university nor the names of its contributors", 1),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 2),
    ("bsd", "provided by the copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties", 2),
    ("bsd", "provided by the regents and contributors", r"this software is provided by the regents and contributors as is", 2),
    ("bsd", "bsd style license that can be found", r"governed by a bsd style license that can be found in the license file", 2),
    ("bsd-2-clause", "the freebsd project", r"official policies either expressed or implied of the freebsd project", 2),
    ("zlib", "this software is provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 2),
    ("zlib", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 2),
    ("zlib", "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 2),
    ("zlib", "this notice may not be removed", r"this notice may not be removed or altered from any source distribution", 1),
    ("apache-2", "you may not use this file except in compliance", r"you may not use this file except in compliance with the license", 1),
    ("apache-2", "licensed under the apache license", r"licensed under the apache license version 2 0 the license", 2),
    ("apache-2", "apache org licenses license 2 0", r"(?:www )?apache org licenses license 2 0", 2),
    ("apache-2", "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 2),
    ("apache-2", "distributed on an as is basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 2),
    ("apache-2", "without warranties or conditions of any kind", r"without warranties or conditions of any kind either express or implied see the license for the specific language", 2),
    ("apache-2", "subject to the terms and conditions of this license each contributor", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive", 2),
    ("apache-1.1", "product includes software developed by the apache", r"this product includes software developed by the apache software foundation", 2),
    ("gpl", "this program is free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 2),
    ("gpl", "free software you can redistribute it", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1),
    ("gpl", "hope that it will be useful", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty", 2),
    ("gpl", "received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with", 2),
    ("gpl", "gnu org licenses gpl", r"gnu org licenses gpl(?: html| txt)?", 2),
    ("gpl-2", "gnu org licenses old licenses gpl 2", r"gnu org licenses old licenses gpl 2 0", 2),
    ("gpl-3", "gnu org licenses gpl 3", r"gnu org licenses gpl 3 0", 2),
    ("gpl", "everyone is permitted to copy and distribute verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 2),
    ("gpl", "licenses for most software are designed", r"the licenses for most software are designed to take away your freedom to share and change it", 2),
    ("gpl-3", "free copyleft license for software", r"is a free copyleft license for software and other kinds of works", 2),
    ("gpl-2", "activities other than copying distribution and modification", r"activities other than copying distribution and modification are not covered by this license", 2),
    ("gpl", "gpl compatible", r"gpl compatible(?: free)?(?: software)? license", 1),
    ("gpl", "released under the gpl", r"(?:is )?released under the gpl", 2),
    ("gpl-2", "gplv2", r"gplv2(?: only)?", 1),
    ("gpl-3", "gplv3", r"gplv3(?: only)?", 1),
    ("gpl-2+", "gplv2 or later", r"gplv2 or later", 1),
    ("gpl-3+", "gplv3 or later", r"gplv3 or later", 1),
    ("lgpl", "this library is free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 2),
    ("lgpl", "received a copy of the gnu l", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 2),
    ("lgpl-2.1", "lgplv2 1", r"lgplv2 1", 1),
    ("lgpl-3", "lgplv3", r"lgplv3", 1),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license along with", 2),
    ("agpl-3", "interacting with it remotely", r"all users interacting with it remotely through a computer network", 2),
    ("agpl-3", "agplv3", r"agplv3", 1),
    ("gfdl", "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 2),
    ("gfdl", "with no invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 2),
    ("mpl-2", "this source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0", 2),
    ("mpl-2", "mozilla org mpl 2 0", r"if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0", 2),
    ("mpl-2", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", 2),
    ("mpl-1.1", "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 2),
    ("mpl-1.1", "alternatively the contents of this file", r"alternatively the contents of this file may be used under the terms of either the gnu general public license", 2),
    ("epl-1", "accompanying materials are made available under the terms of the eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 2),
    ("epl-2", "accompanying materials are made available under the terms of the eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0", 2),
    ("epl-2", "eclipse org legal epl 2 0", r"eclipse org legal epl 2 0", 2),
    ("cddl-1.0", "common development and distribution license", r"the contents of this file are subject to the terms of the common development and distribution license", 2),
    ("cddl-1.0", "cddl header start", r"cddl header start", 2),
    ("artistic-1", "intent of this document is to state the conditions", r"the intent of this document is to state the conditions under which a package may be copied", 2),
    ("artistic-2", "this license establishes the terms", r"this license establishes the terms under which a given free software package may be copied modified distributed", 2),
    ("perl", "same terms as perl itself", r"free software you can redistribute it and or modify it under the same terms as perl itself", 2),
    ("psf-2", "python software foundation psf and the individual", r"this license agreement is between the python software foundation psf and the individual or organization licensee", 2),
    ("boost-1.0", "see accompanying file license 1 0 txt", r"see accompanying file license 1 0 txt or copy at .{0,20}boost org", 2),
    ("boost-1.0", "boost org license 1 0", r"boost org license 1 0 txt", 2),
    ("boost-1.0", "a copy of the software and accompanying documentation", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 2),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain", 2),
    ("unlicense", "anyone is free to copy modify publish", r"anyone is free to copy modify publish use compile sell or distribute this software", 2),
    ("unlicense", "dedicate any and all copyright interest", r"dedicate any and all copyright interest in the software to the public domain", 2),
    ("cc0-1", "waived all copyright and related", r"has waived all copyright and related or neighboring rights to this work", 2),
    ("cc0-1", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0(?: legalcode)?", 2),
    ("cc-by", "creativecommons org licenses by", r"creativecommons org licenses by [1-4] [05]", 2),
    ("cc-by-sa", "creativecommons org licenses by sa", r"creativecommons org licenses by sa [1-4] [05]", 2),
    ("cc-by-nd", "creativecommons org licenses by nd", r"creativecommons org licenses by nd [1-4] [05]", 2),
    ("cc-by-nc", "creativecommons org licenses by nc", r"creativecommons org licenses by nc [1-4] [05]", 2),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa [1-4] [05]", 2),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd [1-4] [05]", 2),
    ("cc-by", "you must give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 2),
    ("cc-by-sa", "distribute your contributions under the same license", r"if you remix transform or build upon the material you must distribute your contributions under the same license", 2),
    ("cc-by-nd", "you may not distribute the modified material", r"if you remix transform or build upon the material you may not distribute the modified material", 2),
    ("cc-by-nc", "may not use the material for commercial purposes", r"you may not use the material for commercial purposes", 2),
    ("odbl-1", "opendatacommons org licenses odbl", r"opendatacommons org licenses odbl(?: 1 0)?", 2),
    ("odbl-1", "database is made available under", r"database is made available under the open database license", 2),
    ("odc-by-1", "opendatacommons org licenses by", r"opendatacommons org licenses by(?: 1 0)?", 2),
    ("pddl-1", "opendatacommons org licenses pddl", r"opendatacommons org licenses pddl(?: 1 0)?", 2),
    ("ofl-1.1", "font software is licensed under", r"this font software is licensed under the sil open font license", 2),
    ("ofl-1.1", "reserved font name", r"with reserved font name", 2),
    ("ofl-1.1", "may be sold by itself", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", 2),
    ("wtfpl", "you just do what the fuck", r"you just do what the fuck you want to", 2),
    ("beerware", "retain this notice you can do whatever", r"as long as you retain this notice you can do whatever you want with this stuff", 2),
    ("curl", "permission to use copy modify", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 2),
    ("openssl", "developed by the openssl project", r"this product includes software developed by the openssl project", 2),
    ("postgresql", "without fee and without a written agreement", r"without fee and without a written agreement is hereby granted provided that the above copyright notice", 2),
    ("json", "shall be used for good not evil", r"the software shall be used for good not evil", 2),
    ("php-3.01", "php license", r"this source file is subject to version 3 01 of the php license that is bundled", 2),
    ("ruby", "same license as ruby", r"(?:under|on) the same license as ruby", 2),
    ("vim", "vim license", r"vim license", 1),
    ("tcl", "tcl tk license", r"tcl tk license", 1),
    ("hpnd", "historical permission notice", r"historical permission notice and disclaimer", 1),
    ("hpnd", "permission to use copy modify distribute and sell", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 2),
    ("ftl", "freetype license", r"freetype license", 1),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 2),
    ("sspl-1", "to third parties as a service", r"making the functionality of the program or modified version available to third parties as a service", 2),
    ("bsl-1.1", "change license", r"change date .{0,60}change license", 2),
    ("bsl-1.1", "additional use grant", r"additional use grant", 1),
    ("commons-clause", "commons clause", r"commons clause license condition", 2),
    ("elastic-2", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 2),
    ("polyform-nc", "polyform noncommercial license", r"polyform noncommercial license(?: 1 0 0)?", 2),
    ("parity", "parity public license", r"parity public license", 2),
    ("rail", "responsible ai license", r"responsible ai license(?:s)?", 2),
    ("rail", "openrail", r"openrail(?: m| d| s)? license", 2),
    ("llama", "community license agreement", r"llama(?: [0-9]+)* community license agreement", 2),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? license(?: agreement)?(?: version)?(?: 2 1)?", 1),
    ("etalab-2", "licence ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?", 1),
    ("open-gov-3", "contains public sector information", r"contains public sector information licensed under the open government licence", 2),
    ("crown", "crown copyright", r"crown copyright(?: and database rights?)?", 1),
    ("dl-de-by-2", "datenlizenz deutschland", r"datenlizenz deutschland(?: namensnennung)?(?: version)? 2 0", 1),
    ("gutenberg", "project gutenberg", r"project gutenberg(?: tm)? license", 2),
    ("gutenberg", "this ebook is for the use of anyone", r"this ebook is for the use of anyone anywhere .{0,160}project gutenberg license", 2),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", 1),
    ("all-rights-reserved", "no part of this publication", r"no part of this publication may be reproduced .{0,120}without the prior (?:written )?permission", 2),
    ("all-rights-reserved", "unauthorized copying of this file", r"unauthorized copying of this file via any medium is strictly prohibited", 2),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:in)?to the public domain", 2),
    ("public-domain", "public domain", r"this (?:work|file|text|document|software|image) is in the public domain", 2),
    ("public-domain", "us government work", r"us government work (?:and )?(?:is )?not subject to copyright", 2),
    ("public-domain", "no known copyright", r"no known copyright restrictions", 2),
    ("proprietary", "proprietary", r"proprietary(?: software)? license", 1),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 1),
    ("proprietary", "trade secret", r"contains (?:confidential and )?(?:proprietary )?trade secrets?", 1),
    ("custom", "end user license agreement", r"end user license agreement", 1),
    ("custom", "freely", r"(?:may|can) be freely (?:used|copied|distributed|redistributed|modified)", 1),
    ("custom", "terms of use", r"use of this (?:site|service|content) is subject to (?:the|our) terms of use", 1),
    ("non-commercial", "non commercial use only", r"(?:licensed )?for (?:personal and )?non commercial use only", 1),
    ("academic-only", "academic", r"for academic (?:and research )?(?:use|purposes) only", 1),
)

CONFIDENCE = {3: 1.0, 2: 0.9, 1: 0.6}


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    regex: str
    priority: int


def signatures() -> tuple[Signature, ...]:
    """All rules in order: every form of every name, then the notices. A match begins and ends with whole words."""
    out = []
    for template, priority in FORMS:
        for label, keyword, name, spdx in NAMES:
            if priority == 3 and spdx is None:  # another name of the license has it
                continue
            gate = "spdx license identifier" if priority == 3 else keyword
            out.append(Signature(label, gate, rf"(?<![^ ]){template.format(name=name, spdx=spdx)}(?![^ ])", priority))
    out += [Signature(label, keyword, rf"(?<![^ ]){regex}(?![^ ])", priority) for label, keyword, regex, priority in NOTICES]
    return tuple(out)


def normalise(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, joined by single spaces."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.btrim(F.regexp_replace(lowered, SEPARATORS, " "), F.lit(" "))


def phrase_places(norm: Column, phrases: tuple[tuple[str, str], ...] = PHRASES) -> Column:
    """Array of ``(word, label)``: every place where the words of a phrase stand consecutively, words from 0."""
    def stands(words: Column, parts: list[str]) -> Callable[[Column], Column]:
        def here(e: Column) -> Column:
            out = e["w"] == parts[0]
            for k, part in enumerate(parts[1:], 1):
                out = out & F.coalesce(F.get(words, e["i"] + k) == part, F.lit(False))
            return out

        return here

    def labelled(label: str) -> Callable[[Column], Column]:
        return lambda e: F.struct(e["i"].cast("long").alias("word"), F.lit(label).alias("label"))

    def places(words: Column) -> Column:
        every = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.concat(*[F.transform(F.filter(every, stands(words, phrase.split(" "))), labelled(label)) for phrase, label in phrases])

    some = F.lit(False)
    for phrase, _ in phrases:
        some = some | F.contains(norm, F.lit(phrase))
    return F.when(some, let(F.split(norm, " "), places)).otherwise(F.array().cast("array<struct<word:bigint,label:string>>"))


DETECTION = "struct<start:bigint,until:bigint,priority:int,number:int,label:string>"
#: Control characters, which no normalised text holds, around a match.
FROM, TO = "\x01", "\x02"


def detections(norm: Column, rules: tuple[Signature, ...]) -> Column:
    """Array of all detections, before suppression; positions are words of the normalised text, from 0."""
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority"), F.lit(k).alias("number")) for k, r in enumerate(rules)])

    def of_rule(rule: Column) -> Column:
        # matches are marked, so that their words can be numbered in one pass
        words = F.split(F.regexp_replace(norm, rule["regex"], F.lit(f"{FROM}$0{TO}")), " ")
        numbered = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i")))

        def placed(every: Column) -> Column:
            starts = F.filter(every, lambda e: F.startswith(e["w"], F.lit(FROM)))
            ends = F.filter(every, lambda e: F.endswith(e["w"], F.lit(TO)))
            return F.zip_with(
                starts, ends,
                lambda a, b: F.struct(a["i"].alias("start"), (b["i"] + 1).alias("until"), rule["priority"].alias("priority"), rule["number"].alias("number"), rule["label"].alias("label")),
            )

        return let(numbered(words), placed)

    some = F.lit(False)
    for anchor in ANCHORS:
        some = some | F.contains(norm, F.lit(anchor))
    gated = F.filter(table, lambda r: F.contains(norm, r["keyword"]))
    return F.when(some, F.flatten(F.transform(gated, of_rule))).otherwise(F.array().cast(f"array<{DETECTION}>"))


def suppress(found: Column) -> Column:
    """``found`` without detections that another of the same or a higher priority contains."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"], (-d["until"]).alias("until"), (-d["priority"]).alias("priority"), d["number"], d["label"])))
    ends = ["end1", "end2", "end3"]  # the furthest end so far of priority 1 and more, 2 and more, 3
    start = F.struct(*[F.lit(-1).cast("long").alias(e) for e in ends], nothing(DETECTION).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        until, priority = -d["until"], -d["priority"]
        reach = F.when(priority == 1, acc["end1"]).when(priority == 2, acc["end2"]).otherwise(acc["end3"])
        one = F.struct(d["start"].alias("start"), until.alias("until"), priority.alias("priority"), d["number"].alias("number"), d["label"].alias("label"))
        kept = F.when(until <= reach, acc["kept"]).otherwise(appended(acc["kept"], one))
        return F.struct(*[F.when(priority >= k, F.greatest(acc[e], until)).otherwise(acc[e]).alias(e) for k, e in enumerate(ends, 1)], kept.alias("kept"))

    return F.aggregate(ordered, start, step, lambda acc: all_of(acc["kept"]))


def scan(docs: DataFrame, rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """``doc_id, n_words``, the base ``places`` (word, label) and the ``detections`` that stay, for every row of ``docs``."""
    rules = rules or signatures()

    def scanned(norm: Column) -> Column:
        spaces = F.char_length(norm) - F.char_length(F.replace(norm, F.lit(" "), F.lit("")))
        return F.struct(
            F.when(norm == "", F.lit(0)).otherwise(spaces + 1).cast("long").alias("n_words"),
            phrase_places(norm).alias("places"),
            let(detections(norm, rules), suppress).alias("detections"),
        )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(normalise(F.col("text")), scanned).alias("found"))
    return found.select("doc_id", "found.*")


def summarise(scanned: DataFrame) -> DataFrame:
    """One line for each row of ``scan``: base places, base labels, all labels and a score, the surest detection's confidence."""
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"]))))
    sure = F.transform("detections", lambda d: F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), d["priority"]))
    words = F.transform("places", lambda p: p["word"])
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(sure), F.lit(0.0)), F.when(F.size("places") > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
