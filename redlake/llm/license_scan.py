"""License scan by ordered signature rules.

A text becomes its words, each between two spaces, so that a phrase is a plain pattern
(" mit  license ") that two neighbouring places don't share characters of. A few searches for
keywords let most texts go by; in the others, each rule whose own keyword is there gives
its places. A place inside one of equal or higher priority is suppressed.

Everything is one projection over the scan: no shuffle, no Python.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, lower_ascii, table

#: ASCII characters that are in no word. The upper-case letters are words' characters too.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A text with a license has one of these, in lower case, whatever the rule.
GATE = (
    "licen", "gpl", "creative", "spdx", "mpl", "eupl", "cddl", "apache", "domain", "rights", "hereby", "unencumbered", "redistribution", "endorse", "verbatim", "prohibited", "proprietary",
    "copyright", "merchantability", "acknowledgement", "misrepresented", "liable", "reproduction", "invariant", "distribute", "beer", "openssl", "wtfpl",
    "berkeley", "x consortium", "not evil", "php software", "cryptographic software",
)
#: "cc" is in too many words to be one; it has to be followed so.
GATE_CC = r"cc0|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by"
#: Short names that mean a license by themselves.
SHORT = ("gpl", "lgpl", "agpl", "mpl", "eupl", "cddl", "apache")
#: The phrases that every scan counts. Fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: A longer and surer signature has a higher priority: 4 a grant or full name with version, 3 an identifier, 2 a name, 1 a mention.
WEIGHT = {4: 1.0, 3: 0.95, 2: 0.8, 1: 0.5}

# Names and versions by license; the rules follow from them.
NAMED = (
    ("apache", "apache", ("1.0", "1.1", "2.0")), ("mpl", "mozilla public", ("1.0", "1.1", "2.0")), ("epl", "eclipse public", ("1.0", "2.0")),
    ("gpl", "gnu general public", ("1.0", "2.0", "3.0")), ("lgpl", "gnu lesser general public", ("2.1", "3.0")), ("lgpl", "gnu library general public", ("2.0",)),
    ("agpl", "gnu affero general public", ("1.0", "3.0")), ("gfdl", "gnu free documentation", ("1.1", "1.2", "1.3")), ("eupl", "european union public", ("1.0", "1.1", "1.2")),
    ("cddl", "common development and distribution", ("1.0", "1.1")), ("cpl", "common public", ("1.0",)), ("artistic", "artistic", ("1.0", "2.0")),
    ("osl", "open software", ("1.0", "2.0", "2.1", "3.0")), ("afl", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")), ("ofl", "sil open font", ("1.0", "1.1")),
    ("bsl", "boost software", ("1.0",)), ("cecill", "cecill", ("1.0", "2.0", "2.1")), ("psf", "python software foundation", ("2.0",)), ("php", "php", ("3.0", "3.01")),
    ("zpl", "zope public", ("1.1", "2.0", "2.1")), ("odbl", "open database", ("1.0",)), ("upl", "universal permissive", ("1.0",)), ("mulan", "mulan permissive software", ("1.0", "2.0")),
)
PLAIN = (
    ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"),
    ("bsd-2-clause", "simplified bsd"), ("bsd-3-clause", "new bsd"), ("bsd-3-clause", "modified bsd"), ("bsd-4-clause", "original bsd"), ("ncsa", "ncsa"), ("x11", "x11"), ("json", "json"), ("beerware", "beerware"),
)
CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?derivatives|no ?derivs", "sa": "share ?alike"}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


# What licenses and the headers of files say: label, priority, keyword and words as a pattern; (a|b) are alternatives, (a)? may be left out. Fixed values.
SIGNATURES = (
    ("mit", 4, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 4, "notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 4, "noninfringement", "merchantability fitness for a particular purpose and noninfringement"),
    ("mit", 3, "license", "this (project|software|library|package|code) is licensed under the (terms of the)? mit license"),
    ("bsl-1.0", 4, "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("isc", 4, "hereby", "permission to use copy modify and (or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 4, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 3, "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 3, "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 4, "endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 4, "endorse", "the names of its contributors may (not)? be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 4, "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("zlib", 4, "liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 4, "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("apache-2.0", 4, "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", 4, "apache", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", 4, "apache", "http www apache org licenses license 2 0"),
    ("apache-2.0", 3, "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", 3, "reproduction", "terms and conditions for use reproduction and distribution"),
    ("gpl-3.0-or-later", 4, "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-or-later", 4, "gnu", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2.0-only", 4, "gnu", "under the terms of (the)? (version 2 of)? the gnu general public license version 2 as published by the free software foundation"),
    ("lgpl-3.0-or-later", 4, "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", 4, "lesser", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3.0-or-later", 4, "affero", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", 3, "gnu", "you should have received a copy of the gnu general public license along with this (program|library|software)"),
    ("lgpl", 3, "lesser", "you should have received a copy of the gnu lesser general public license along with this (program|library|software)"),
    ("agpl", 3, "affero", "you should have received a copy of the gnu affero general public license along with this (program|library|software)"),
    ("gpl", 2, "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", 2, "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gfdl", 4, "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 4, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 3, "mozilla", "you can obtain one at (http|https) mozilla org mpl 2 0"),
    ("mpl-1.1", 4, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", 4, "eclipse", "are made available under the terms of the eclipse public license (v|version)? 2 0"),
    ("epl-1.0", 4, "eclipse", "are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", 4, "common", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("ofl-1.1", 4, "font", "this font software is licensed under the sil open font license version 1 1"),
    ("artistic-2.0", 4, "artistic", "you may distribute under the terms of the artistic license 2 0"),
    ("unlicense", 4, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 3, "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 4, "want", "do what the (fuck|heck) you want to public license"),
    ("beerware", 4, "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("cc", 3, "creative", "this work is licensed under (a|the) creative commons"),
    ("cc0-1.0", 4, "waived", "has waived all copyright and related or neighboring rights to"),
    ("public-domain", 3, "domain", "(released|placed|dedicated) (into|in|to) the public domain"),
    ("psf-2.0", 4, "python", "this license agreement is between the python software foundation"),
    ("openssl", 4, "openssl", "this product includes software developed by the openssl project"),
    ("proprietary", 3, "prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 3, "proprietary", "proprietary and confidential"),
    # Grants and conditions in the texts of licenses.
    ("apache-2.0", 4, "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", 3, "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2.0", 4, "basis", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", 3, "governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 3, "derivative", "you must give any other recipients of the work or derivative works a copy of this license"),
    ("apache-1.1", 4, "apache", "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation"),
    ("apache-1.1", 3, "endorse", "the names apache and apache software foundation must not be used to endorse or promote products derived from this software"),
    ("mit", 3, "whom", "to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"),
    ("mit", 3, "sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 3, "holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", 4, "furnished", "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("mit-cmu", 4, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", 4, "appear", "provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("isc", 3, "disclaims", "the software is provided as is and (the author|isc) disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", 4, "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", 3, "contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", 3, "regents", "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("bsd", 2, "procurement", "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("bsd-3-clause", 3, "university", "neither the name of the university nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 3, "endorse", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", 4, "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", 3, "berkeley", "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd", 3, "bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("zlib", 3, "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("curl", 4, "holder", "except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("x11", 4, "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("json", 4, "evil", "the software shall be used for good not evil"),
    ("unlicense", 3, "relinquishment", "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software"),
    ("unlicense", 3, "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", 3, "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("gpl-3.0", 4, "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", 3, "convey", "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2.0", 3, "verbatim", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2.0", 3, "distribute", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-2.0", 3, "temple", "write to the free software foundation inc 59 temple place suite 330 boston ma 02111 1307 usa gnu general public license"),
    ("gpl", 3, "hope", "this (program|library|software) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", 3, "details", "see the gnu general public license for more details"),
    ("lgpl", 3, "details", "see the gnu (lesser|library) general public license for more details"),
    ("agpl", 3, "details", "see the gnu affero general public license for more details"),
    ("gpl", 3, "general", "under the terms of the gnu general public license"),
    ("lgpl", 3, "lesser", "under the terms of the gnu lesser general public license"),
    ("agpl", 3, "affero", "under the terms of the gnu affero general public license"),
    ("lgpl-2.1", 4, "lesser", "this license the lesser general public license applies to some specially designated software packages typically libraries"),
    ("lgpl-3.0", 4, "lesser", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl-2.0-or-later", 4, "library", "under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-with-gcc-exception", 4, "runtime", "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("gpl-2.0-with-linux-syscall-note", 4, "kernel", "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("gfdl", 4, "document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 3, "manual", "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("mpl-2.0", 3, "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-2.0", 3, "intellectual", "each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights other than patent or trademark licensable by such contributor"),
    ("mpl-1.1", 3, "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later"),
    ("mpl-1.0", 4, "contents", "the contents of this file are subject to the netscape public license version 1"),
    ("epl-2.0", 3, "accompanying", "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program"),
    ("cpl-1.0", 4, "common", "the accompanying program is provided under the terms of this common public license agreement any use reproduction or distribution"),
    ("ipl-1.0", 4, "ibm", "the accompanying program is provided under the terms of this ibm public license agreement any use reproduction or distribution"),
    ("cddl-1.0", 3, "opensource", "you can obtain a copy of the license at (http|https) www opensource org licenses cddl1 php"),
    ("cddl-1.1", 4, "glassfish", "you can obtain a copy of the license at (http|https) glassfish dev java net public cddl gpl html"),
    ("eupl", 4, "eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("osl-3.0", 4, "open", "licensed under the open software license version 3 0"),
    ("afl-3.0", 4, "academic", "licensed under the academic free license version 3 0"),
    ("artistic-1.0", 4, "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", 3, "redistributed", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", 4, "perl", "you can redistribute it and or modify it under the same terms as perl itself this is licensed"),
    ("ruby", 4, "restriction", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("php-3.01", 4, "php", "this product includes php software freely available from (http|https) www php net software"),
    ("php-3.01", 3, "php", "this source file is subject to version 3 01 of the php license"),
    ("php-3.0", 3, "php", "this source file is subject to version 3 0 of the php license"),
    ("openssl", 3, "cryptographic", "this product includes cryptographic software written by eric young"),
    ("openssl", 3, "toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("psf-2.0", 3, "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"),
    ("cnri-python", 4, "cnri", "cnri hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform"),
    ("zpl-2.1", 3, "zope", "this software is subject to the provisions of the zope public license version 2 1"),
    ("w3c", 4, "copyright", "this work is being provided by the copyright holders under the following license by obtaining using and or copying this work"),
    ("unicode-dfs", 4, "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files and any associated documentation"),
    ("icu", 4, "icu", "permission is hereby granted free of charge to any person obtaining a copy of this software the icu license"),
    ("ofl-1.1", 3, "reserved", "no modified version of the font software may use the reserved font name s unless explicit written permission is granted by the corresponding copyright holder"),
    ("ofl-1.1", 3, "bundled", "original or modified versions of the font software may be bundled redistributed and or sold with any software provided that each copy contains the above copyright notice and this license"),
    ("odbl-1.0", 3, "database", "any rights in individual contents of the database are licensed under the database contents license"),
    ("odc-by-1.0", 4, "attribution", "open data commons attribution license"),
    ("pddl-1.0", 4, "dedication", "open data commons public domain dedication and license"),
    ("upl-1.0", 3, "larger", "the larger works to which the software is contributed by such licensors"),
    ("mulan-2.0", 3, "mulan", "you can use this software according to the terms and conditions of the mulan psl v2 you may obtain a copy of mulan psl v2 license at"),
    ("ms-pl", 4, "microsoft", "microsoft public license ms pl"),
    ("ms-rl", 4, "microsoft", "microsoft reciprocal license ms rl"),
    ("ms-pl", 3, "accept", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("sspl-1.0", 4, "server", "server side public license"),
    ("sspl-1.0", 3, "service", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available via network download to everyone at no charge under the terms of this license"),
    ("busl-1.1", 4, "business", "business source license 1 1"),
    ("busl-1.1", 3, "production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", 4, "elastic", "elastic license (v|version)? 2 0"),
    ("elastic-2.0", 3, "hosted", "you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features or functionality of the software licensor"),
    ("commons-clause", 4, "commons", "commons clause license condition"),
    ("polyform-noncommercial-1.0", 4, "polyform", "polyform noncommercial license 1 0 0"),
    ("cc0-1.0", 3, "unconditionally", "to the greatest extent permitted by but not in contravention of applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("cc", 3, "exercising", "by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", 3, "creativecommons", "to view a copy of this license visit (http|https) creativecommons org licenses"),
    ("cc-by", 3, "licenses", "creativecommons org licenses by 4 0"),
    ("cc-by-sa", 3, "licenses", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc", 3, "licenses", "creativecommons org licenses by nc 4 0"),
    ("cc-by-sa", 3, "licenses", "creativecommons org licenses by sa 3 0"),
    ("public-domain", 3, "dedicated", "this work has been dedicated to the public domain by waiving all rights"),
    ("public-domain", 3, "government", "this is a work of the united states government and is not subject to copyright protection in the united states"),
    ("crown-copyright", 4, "government", "licensed under the open government licence v3 0"),
    ("ogl-3.0", 4, "sector", "contains public sector information licensed under the open government licence"),
    ("proprietary", 3, "disclose", "you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement"),
    ("proprietary", 3, "software", "this software is licensed not sold"),
    ("proprietary", 3, "reverse", "you may not reverse engineer decompile or disassemble the (software|product) copyright"),
    ("proprietary", 3, "unpublished", "unpublished rights reserved under the copyright laws of the united states"),
    ("proprietary", 3, "trade", "this (software|file|document) contains (confidential|proprietary) information and trade secrets copyright"),
)


def _signature(words: str) -> str:
    """A pattern of whole words; an alternative is one or more words."""
    out = []
    for part in re.findall(r"\([^)]*\)\??|\S+", words):
        if part.startswith("("):
            out.append("(?:" + "|".join(_words(x) for x in part.strip("()?").split("|")) + ")" + "?" * part.endswith("?"))
        else:
            out.append(f" {part} ")
    return "".join(out)


def _words(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _version(v: str) -> str:
    """2.0 is also 2, 2 0, v2 and v2 0."""
    major, minor = v.split(".")
    return f" v?{major} " + (f"(?: {minor} )?" if minor == "0" else f" {minor} ")


def rules() -> list[dict]:
    """Every rule in order: pattern, the keyword that must be there, label, priority, whether it is a base phrase."""
    found: list[tuple[str, str, str, int]] = []
    for label, name, versions in NAMED:
        full, key = _words(name), max(name.split(), key=len)
        for v in versions:
            named = f"{label}-{v}"
            found.append((f"{full} licen[sc]e (?: version )?{_version(v)}", key, named, 4))
            found.append((f"{full} licen[sc]e  v{v.split('.')[0]}{v.split('.')[1] if v[-1] != '0' else ''} ", key, named, 4))
            found.append((f" spdx  license  identifier  {label} {_version(v)}", "spdx", named, 4))
            if label in SHORT:
                found += [(f" {label} {_version(v)}", label, named, 3), (f" {label}v{v.split('.')[0]} ", f"{label}v", named, 3)]
            if label in ("gpl", "lgpl", "agpl"):
                found += [
                    (f"{full} license  version {_version(v)}(?: of  the  license )? or (?: at  your  option )?(?: any )? later (?: version )?", key, f"{named}-or-later", 4),
                    (f" {label} {_version(v)} or  later ", label, f"{named}-or-later", 4),
                    (f" {label} {_version(v)} only ", label, f"{named}-only", 4),
                ]
        found.append((f"{full} licen[sc]e ", key, label, 2))
    for label, name in PLAIN:
        full, key = _words(name), max(name.split(), key=len)
        found += [
            (f" (?:licensed|released|distributed|available)  under (?: (?:the|a|an) )?(?: terms  of  the )?{full}(?: style )? licen[sc]e ", key, label, 4),
            (f" licen[sc]e {full}", key, label, 3),
            (f" spdx  license  identifier {full}", "spdx", label, 4),
            (f"{full} licen[sc]e ", key, label, 2),
        ]
    for kind, v in itertools.product(CC_KINDS, CC_VERSIONS):
        parts = kind.split("-")
        named = "".join(f" (?:{CC_PARTS[p].replace(' ?', '(?:  )?')}) " for p in parts)
        number = f" {v.split('.')[0]}  {v.split('.')[1]} "
        found += [(f" cc {_words(' '.join(parts))}{number}", "cc", f"cc-{kind}-{v}", 4), (f" creative  commons {named}(?: international | unported | license )*{number}", "commons", f"cc-{kind}-{v}", 4)]
    for kind in CC_KINDS:
        found += [(f" cc {_words(' '.join(kind.split('-')))}", "cc", f"cc-{kind}", 2), (f" creative  commons {_words(CC_PARTS['by'])}", "commons", "cc-by", 1)]
    found += [
        (" cc0 ", "cc0", "cc0-1.0", 3), (" creative  commons  zero ", "commons", "cc0-1.0", 3), (" public  domain ", "domain", "public-domain", 1),
        (" permission  is  hereby  granted  free  of  charge ", "hereby", "mit", 3), (" this  is  free  and  unencumbered  software ", "unencumbered", "unlicense", 3),
        (" redistribution  and  use  in  source  and  binary  forms ", "redistribution", "bsd", 2), (" all  rights  reserved ", "reserved", "proprietary", 1),
        *((_signature(words), key, label, priority) for label, priority, key, words in SIGNATURES),
    ]
    out = [{"pattern": _words(p), "keyword": p.split()[0], "label": label, "priority": 1, "base": True} for p, label in BASE]
    seen = set()
    for pattern, key, label, priority in found:
        if pattern not in seen:
            seen.add(pattern)
            out.append({"pattern": pattern, "keyword": key, "label": label, "priority": priority, "base": False})
    return out


def _places(norm: Column, rule: Column) -> Column:
    """The places of one rule: start and end in words, from what lies between the matches."""
    between, found = F.split(norm, rule.pattern, -1), F.regexp_extract_all(norm, rule.pattern, F.lit(0))
    n = lambda s: (F.size(F.split(s, " ", -1)) - 1) / 2
    steps = F.zip_with(between, found, lambda b, m: F.when(m.isNotNull(), F.struct(n(b).cast("int").alias("skip"), n(m).cast("int").alias("take"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,p:int,o:int,label:string,base:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a.at + x.skip
        place = F.struct(s.alias("s"), (s + x["take"]).alias("e"), rule.priority.alias("p"), rule.o.alias("o"), rule.label.alias("label"), rule.base.alias("base"))
        return F.struct((s + x["take"]).alias("at"), F.concat(a.out, F.array(place)).alias("out"))

    return F.aggregate(F.filter(steps, lambda x: x.isNotNull()), start, step, lambda a: a.out)


def _surviving(places: Column) -> Column:
    """Places not inside one of equal or higher priority that starts no later.

    In the order of start, longest first, then priority, then rule, a place is inside an
    earlier one if that one's end is no smaller: the largest end so far of each priority
    is enough.
    """
    order = F.array_sort(places, lambda a, b: F.when(a.s != b.s, a.s - b.s).when(a.e != b.e, b.e - a.e).when(a.p != b.p, b.p - a.p).otherwise(a.o - b.o))
    start = F.struct(F.array(*[F.lit(-1)] * 4).alias("most"), F.array().cast("array<struct<s:int,e:int,p:int,o:int,label:string,base:boolean>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside = F.element_at(a.most, x.p) >= x.e
        most = F.transform(a.most, lambda m, i: F.when(i < x.p, F.greatest(m, x.e)).otherwise(m))
        return F.struct(most.alias("most"), F.when(inside, a.out).otherwise(F.concat(a.out, F.array(x))).alias("out"))

    return F.aggregate(order, start, step, lambda a: a.out)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, `places` (all, of every rule) and `detections` (those left).

    A null text counts as empty: no words, no places. Equal rows get equal results; other
    columns are not read. Places are as many as the text has; none is capped.
    """
    table_ = F.array(
        *[
            F.struct(F.lit(r["pattern"]).alias("pattern"), F.lit(r["keyword"]).alias("keyword"), F.lit(r["priority"]).alias("priority"), F.lit(i).alias("o"), F.lit(r["label"]).alias("label"), F.lit(r["base"]).alias("base"))
            for i, r in enumerate(rules())
        ]
    )
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_words = bind(F.split(F.col("text"), SEPARATOR, -1), lambda w: F.size(w) - (F.element_at(w, 1) == "").cast("int") - (F.element_at(w, -1) == "").cast("int"))

    def gate(low: Column) -> Column:
        found = F.lit(False)
        for key in GATE:
            found |= F.contains(low, F.lit(key))
        return found | (F.contains(low, F.lit("cc")) & low.rlike(GATE_CC))

    def norm(text: Column) -> Column:
        words = F.filter(F.split(lower_ascii(text), SEPARATOR, -1), lambda w: w != "")
        return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))

    def places(text: Column) -> Column:
        return F.flatten(F.transform(F.filter(table_, lambda r: F.contains(text, r.keyword)), lambda r: _places(text, r)))

    none = F.array().cast("array<struct<s:int,e:int,p:int,o:int,label:string,base:boolean>>")
    both = F.when(bind(F.lower(F.col("text")), gate), bind(bind(norm(F.col("text")), places), lambda p: F.struct(p.alias("places"), _surviving(p).alias("detections")))).otherwise(F.struct(none.alias("places"), none.alias("detections")))
    return d.select("doc_id", F.greatest(n_words, F.lit(0)).cast("long").alias("n_words"), both.alias("b")).select("doc_id", "n_words", "b.places", "b.detections")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p.base)
    labels = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda p: p.label)))
    weight = F.create_map(*[F.lit(x) for pair in WEIGHT.items() for x in pair])
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p.s)).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p.s)).cast("long").alias("last_word"),
        F.array_join(labels(base), ",").alias("base_labels"),
        F.array_join(labels(F.concat(base, "detections")), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda p: F.element_at(weight, p.p))), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = f"""
WITH r(o, pattern, keyword, label, p, base) AS (VALUES {", ".join(f"({i}, {_sql(r['pattern'])}, {_sql(r['keyword'])}, {_sql(r['label'])}, {r['priority']}, {str(r['base']).lower()})" for i, r in enumerate(rules()))}),
t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_sql(SEPARATOR)}), lambda w: w <> '') AS w FROM documents),
n AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM t),
m AS (SELECT rid, o, label, p, base, regexp_split_to_array(norm, pattern) AS b, regexp_extract_all(norm, pattern) AS f FROM n JOIN r ON contains(norm, keyword)),
k AS (SELECT rid, o, label, p, base, b, f, unnest(range(1, len(f) + 1)) AS i FROM m WHERE len(f) > 0),
q AS (SELECT rid, o, label, p, base, (len(array_to_string(b[1:i], '')) - len(replace(array_to_string(b[1:i], ''), ' ', ''))) // 2 + (len(array_to_string(f[1:i - 1], '')) - len(replace(array_to_string(f[1:i - 1], ''), ' ', ''))) // 2 AS s,
    (len(f[i]) - len(replace(f[i], ' ', ''))) // 2 AS l FROM k),
d AS (SELECT * FROM q AS x WHERE NOT EXISTS (SELECT 1 FROM q AS y WHERE y.rid = x.rid AND y.s <= x.s AND y.s + y.l >= x.s + x.l AND y.p >= x.p
    AND (y.s < x.s OR y.l > x.l OR y.p > x.p OR y.o < x.o))),
a AS (SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels FROM q GROUP BY rid),
e AS (SELECT rid, max(CASE p WHEN 4 THEN 1.0 WHEN 3 THEN 0.95 WHEN 2 THEN 0.8 ELSE 0.5 END)::DOUBLE AS score, count(*) AS n_detections FROM d GROUP BY rid),
g AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM d UNION ALL SELECT rid, label FROM q WHERE base) GROUP BY rid)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_detections, 0) AS n_detections
FROM n LEFT JOIN a USING (rid) LEFT JOIN e USING (rid) LEFT JOIN g USING (rid)
"""
