"""License detection by ordered signature rules.

A text is normalised to its words, A-Z lower-cased, with one blank around each, so that rules are short regular
expressions over words. A rule has a keyword (one word of each of its matches), without which it is not tried, a
priority, a label and a confidence.
Detections are word intervals; one that lies inside an interval of higher priority (or of equal priority and
greater length) is suppressed, in one sweep over the intervals in order. Rules are hand-written signatures of license
texts, file headers and addresses, then those from a table of names and identifiers and a few kinds of notice.

Everything is a built-in DataFrame expression on the row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose places are always reported, with their labels.
BASE_PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Label, keyword, the license's names (as regular expressions over words), its short identifiers.
LICENSES = [
    ("agpl-3.0", "affero", ["gnu affero general public license(?: version| v)? v?3(?: 0)?", "affero gpl(?: version)? 3"], ["agpl 3 0(?: only| or later)?", "agplv3"]),
    ("agpl", "affero", ["gnu affero general public license", "affero general public license", "gnu agpl"], ["agpl"]),
    ("apache-1.1", "apache", ["apache software license(?: version)? 1 1"], ["apache 1 1"]),
    ("apache-2.0", "apache", ["apache license(?: version)? v?2(?: 0)?", "apache software license(?: version)? 2(?: 0)?"], ["apache 2 0", "asl 2 0"]),
    ("apache", "apache", ["apache license", "apache software license"], ["apache licen[cs]ed"]),
    ("artistic-1.0", "artistic", ["artistic license(?: version)? 1(?: 0)?"], ["artistic 1 0"]),
    ("artistic-2.0", "artistic", ["artistic license(?: version)? 2(?: 0)?"], ["artistic 2 0"]),
    ("artistic", "artistic", ["artistic license", "perl artistic license"], ["artistic licen[cs]ed"]),
    ("beerware", "beer", ["beer ware license", "beerware license"], ["beer ware"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause license", "simplified bsd license", "freebsd license", "two clause bsd license"], ["bsd 2 clause"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause license", "new bsd license", "modified bsd license", "revised bsd license", "three clause bsd license"], ["bsd 3 clause"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause license", "original bsd license", "four clause bsd license"], ["bsd 4 clause"]),
    ("0bsd", "bsd", ["zero clause bsd license", "bsd zero clause license", "free public license 1 0 0"], ["0bsd"]),
    ("bsd", "bsd", ["bsd license", "berkeley software distribution license", "bsd style license"], ["bsd licen[cs]ed"]),
    ("bsl-1.0", "boost", ["boost software license(?: version)? 1 0", "boost software license"], ["bsl 1 0"]),
    ("busl-1.1", "business", ["business source license(?: version)? 1 1", "business source license"], ["busl 1 1"]),
    ("cc0-1.0", "cc0", ["cc0 1 0 universal", "cc0 public domain dedication", "creative commons zero", "creative commons cc0"], ["cc0(?: 1 0)?"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd(?: [1-4] [05])?"], ["cc by nc nd"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa(?: [1-4] [05])?"], ["cc by nc sa"]),
    ("cc-by-nc", "cc", ["cc by nc(?: [1-4] [05])?(?! sa| nd)"], ["cc by nc"]),
    ("cc-by-nd", "cc", ["cc by nd(?: [1-4] [05])?"], ["cc by nd"]),
    ("cc-by-sa", "cc", ["cc by sa(?: [1-4] [05])?"], ["cc by sa"]),
    ("cc-by-4.0", "cc", ["cc by 4(?: 0)?"], ["cc by 4 0"]),
    ("cc-by-3.0", "cc", ["cc by 3(?: 0)?"], ["cc by 3 0"]),
    ("cc-by-nc", "creative", ["creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: license)?"], ["creative commons by nc"]),
    ("cc-by-sa", "creative", ["creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?"], ["creative commons by sa"]),
    ("cc-by-nd", "creative", ["creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: license)?"], ["creative commons by nd"]),
    ("cc-by", "creative", ["creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)?"], ["creative commons by"]),
    ("cddl-1.0", "cddl", ["common development and distribution license", "cddl(?: version)? 1 0"], ["cddl 1 0"]),
    ("cecill", "cecill", ["cecill free software license agreement", "cecill license"], ["cecill 2 1", "cecill b", "cecill c"]),
    ("epl-1.0", "eclipse", ["eclipse public license(?: version| v)? v?1(?: 0)?"], ["epl 1 0"]),
    ("epl-2.0", "eclipse", ["eclipse public license(?: version| v)? v?2(?: 0)?"], ["epl 2 0"]),
    ("epl", "eclipse", ["eclipse public license"], ["epl licen[cs]ed"]),
    ("eupl", "european", ["european union public licen[cs]e(?: version)?(?: 1 [012])?"], ["eupl 1 [012]"]),
    ("gfdl", "gnu", ["gnu free documentation license(?: version)?(?: 1 [123])?"], ["gfdl 1 [123]"]),
    ("gpl-1.0", "gnu", ["gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?1(?: 0)?"], ["gpl 1 0(?: only| or later)?"]),
    ("gpl-2.0", "gnu", ["gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?2(?: 0)?", "gnu gpl v?2(?: 0)?"], ["gpl 2 0(?: only| or later)?"]),
    ("gpl-3.0", "gnu", ["gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? v?3(?: 0)?", "gnu gpl v?3(?: 0)?"], ["gpl 3 0(?: only| or later)?"]),
    ("gpl", "gnu", ["gnu general public license", "gnu gpl"], ["gnu licen[cs]ed"]),
    ("gpl-2.0", "gplv2", ["gplv2 license"], ["gplv2"]),
    ("gpl-3.0", "gplv3", ["gplv3 license"], ["gplv3"]),
    ("gpl", "gpl", ["gpl license", "general public license gpl"], ["gpl licen[cs]ed"]),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license(?: version| v)? v?2 1"], ["lgpl 2 1"]),
    ("lgpl-3.0", "lesser", ["gnu lesser general public license(?: version| v)? v?3(?: 0)?"], ["lgpl 3 0"]),
    ("lgpl", "lesser", ["gnu lesser general public license", "lesser general public license"], ["gnu lgpl"]),
    ("lgpl-2.0", "library", ["gnu library general public license(?: version)?(?: 2(?: 0)?)?"], ["lgpl 2 0"]),
    ("isc", "isc", ["isc license", "internet systems consortium license"], ["isc licen[cs]ed"]),
    ("mit-0", "mit", ["mit no attribution license", "mit no attribution"], ["mit 0"]),
    ("mit", "mit", ["mit license", "mit x11 license", "mit expat license", "mit x consortium license"], ["mit licen[cs]ed"]),
    ("mit", "expat", ["expat license"], ["expat licen[cs]ed"]),
    ("mpl-1.1", "mozilla", ["mozilla public license(?: version| v)? v?1 1"], ["mpl 1 1"]),
    ("mpl-2.0", "mozilla", ["mozilla public license(?: version| v)? v?2(?: 0)?"], ["mpl 2 0"]),
    ("mpl", "mozilla", ["mozilla public license"], ["mpl licen[cs]ed"]),
    ("ms-pl", "microsoft", ["microsoft public license"], ["ms pl"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"], ["ms rl"]),
    ("odbl", "database", ["open database license(?: version| v)?(?: 1 0)?"], ["odbl 1 0"]),
    ("ofl-1.1", "sil", ["sil open font license(?: version)?(?: 1 1)?"], ["ofl 1 1"]),
    ("openssl", "openssl", ["openssl license", "original ssleay license"], ["openssl licen[cs]ed"]),
    ("osl-3.0", "open", ["open software license(?: version| v)?(?: 3 0)?"], ["osl 3 0"]),
    ("php-3.01", "php", ["php license(?: version)?(?: 3 01)?"], ["php 3 01"]),
    ("psf-2.0", "python", ["python software foundation license(?: version)?(?: 2)?", "python license"], ["psf 2 0"]),
    ("public-domain", "domain", ["released into the public domain", "dedicated to the public domain", "placed in the public domain"], ["public domain dedication"]),
    ("ruby", "ruby", ["ruby license"], ["ruby licen[cs]ed"]),
    ("sspl-1.0", "side", ["server side public license(?: version| v)?(?: 1)?"], ["sspl 1 0"]),
    ("unlicense", "unlicense", ["the unlicense", "this is free and unencumbered software released into the public domain"], ["unlicense"]),
    ("upl-1.0", "universal", ["universal permissive license(?: version| v)?(?: 1 0)?"], ["upl 1 0"]),
    ("vim", "vim", ["vim license"], ["vim licen[cs]ed"]),
    ("w3c", "w3c", ["w3c software notice and license", "w3c software and document notice and license"], ["w3c 2015"]),
    ("wtfpl", "wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["wtfpl 2"]),
    ("x11", "x11", ["x11 license"], ["x11 licen[cs]ed"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"], ["zlib licen[cs]ed"]),
    ("zpl-2.1", "zope", ["zope public license(?: version| v)?(?: 2 [01])?"], ["zpl 2 1"]),
    ("proprietary", "reserved", ["all rights reserved"], ["proprietary and confidential all rights reserved"]),
]

# Signatures of license texts and headers (label, keyword, confidence, regular expression over words).
SIGNATURES = [
    ("mit", "permission", 0.95, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", 0.95, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "substantial", 0.9, "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", 0.8, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("x11", "advertising", 0.9, "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("mit", "opensource", 0.9, "opensource org licenses mit(?: license)?"),
    ("mit", "mit", 0.9, "mit licence"),
    ("mit", "mit", 0.8, "(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit(?! press)"),
    ("bsd", "redistribution", 0.9, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 0.9, "redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", 0.9, "redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "warranties", 0.8, "this software is provided by the (?:copyright holders?|regents|authors?) and contributors as is and any express or implied warranties"),
    ("bsd-3-clause", "endorse", 0.95, "neither the names? of (?:the copyright holders?|the university|the author|the company|the organization) nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse", 0.9, "the names? of the (?:authors?|copyright holders?) may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 0.95, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "patent", 0.95, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd", "opensource", 0.9, "opensource org licenses bsd license"),
    ("bsd-2-clause", "opensource", 0.9, "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource", 0.9, "opensource org licenses bsd 3 clause"),
    ("0bsd", "fee", 0.8, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("isc", "fee", 0.95, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("isc", "disclaims", 0.9, "the software is provided as is and (?:the author|isc|internet systems consortium) disclaims all warranties with regard to this software"),
    ("isc", "opensource", 0.9, "opensource org licenses isc"),
    ("hpnd", "permission", 0.8, "permission to use copy modify and distribute this software and its documentation for any purpose(?! without fee and without)"),
    ("postgresql", "agreement", 0.95, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("apache-2.0", "compliance", 1.0, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "apache", 0.95, "apache org licenses license 2 0"),
    ("apache-2.0", "basis", 0.8, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "irrevocable", 0.9, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license"),
    ("apache-2.0", "contribution", 0.8, "contribution intentionally submitted for inclusion in the work"),
    ("apache-1.1", "acknowledgment", 0.9, "the end user documentation included with the redistribution if any must include the following acknowledgment"),
    ("apache", "apache", 0.8, "this product includes software developed (?:by|at) the apache (?:software foundation|group)"),
    ("gpl-2.0", "gnu", 1.0, "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "gnu", 1.0, "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "gnu", 1.0, "under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2) (?:only )?as published by the free software foundation"),
    ("gpl", "gnu", 0.9, "you should have received a copy of the gnu general public license along with (?:this|the) (?:program|file|software)"),
    ("gpl", "useful", 0.7, "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-3.0", "copyleft", 0.95, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "propagate", 0.9, "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable"),
    ("gpl-2.0", "freedom", 0.9, "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", "activities", 0.8, "activities other than copying distribution and modification are not covered by this license"),
    ("gpl", "gnu", 0.9, "gnu org (?:licenses|copyleft) gpl"),
    ("gpl-2.0", "gpl", 0.9, "gpl (?:version |v ?)2(?: 0)?(?: only| or later| or newer| or any later version)?"),
    ("gpl-3.0", "gpl", 0.9, "gpl (?:version |v ?)3(?: 0)?(?: only| or later| or newer| or any later version)?"),
    ("gpl", "gpl", 0.7, "(?:under|of|by|with) the (?:gnu )?gpl(?: license| licence)?"),
    ("gpl", "gpl", 0.8, "(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl"),
    ("lgpl-2.1", "lgpl", 0.9, "lgpl (?:version |v ?)2 1(?: only| or later| or newer| or any later version)?"),
    ("lgpl-2.0", "lgpl", 0.9, "lgpl (?:version |v ?)2(?: 0)?(?: only| or later| or newer| or any later version)?(?! 1)"),
    ("lgpl-3.0", "lgpl", 0.9, "lgpl (?:version |v ?)3(?: 0)?(?: only| or later| or newer| or any later version)?"),
    ("lgpl-3.0", "lgplv3", 0.9, "lgplv3(?: only| or later)?"),
    ("lgpl-2.1", "lgplv2", 0.9, "lgplv2 1(?: only| or later)?"),
    ("lgpl", "lgpl", 0.7, "(?:under|of|by|with) the (?:gnu )?lgpl(?: license| licence)?"),
    ("agpl-3.0", "agpl", 0.9, "agpl (?:version |v ?)3(?: 0)?(?: only| or later)?"),
    ("agpl", "agpl", 0.7, "(?:under|of|by|with) the (?:gnu )?agpl"),
    ("gpl-2.0-classpath", "linking", 0.95, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("lgpl-2.1", "lesser", 1.0, "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "lesser", 1.0, "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.0", "library", 1.0, "gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "lesser", 0.9, "you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("lgpl-2.1", "lesser", 0.9, "this license the lesser general public license applies to some specially designated software packages"),
    ("lgpl-3.0", "lesser", 0.95, "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl", "gnu", 0.9, "gnu org (?:licenses|copyleft) (?:lgpl|lesser)"),
    ("agpl-3.0", "affero", 1.0, "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "affero", 0.9, "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3.0", "affero", 0.95, "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "remote", 0.9, "remote network interaction use with the gnu general public license"),
    ("agpl-3.0", "gnu", 0.9, "gnu org licenses agpl"),
    ("gfdl", "documentation", 0.95, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "gnu", 0.9, "gnu org (?:licenses|copyleft) fdl"),
    ("mpl-2.0", "mozilla", 1.0, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mpl", 0.95, "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "covered", 0.8, "covered software is provided under this license on an as is basis"),
    ("mpl-1.1", "mozilla", 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", 1.0, "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2.0", "mozilla", 0.9, "mozilla org (?:en us )?mpl 2 0"),
    ("npl-1.1", "netscape", 0.95, "subject to the netscape public license version 1 1"),
    ("epl-1.0", "eclipse", 1.0, "made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2.0", "eclipse", 1.0, "made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("epl", "eclipse", 0.9, "the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-1.0", "eclipse", 0.9, "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", 0.9, "eclipse org legal epl (?:2 0|v20)"),
    ("cpl-1.0", "accompanying", 0.9, "the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "ibm", 0.9, "ibm public license version 1 0"),
    ("cddl-1.0", "development", 0.95, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "liable", 0.9, "this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages"),
    ("zlib", "misrepresented", 0.95, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "misrepresented", 0.95, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "png", 0.9, "the png reference library is supplied as is"),
    ("bsl-1.0", "organization", 0.95, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", "boost", 0.9, "boost org license 1 0"),
    ("unlicense", "compile", 0.95, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense", 0.9, "refer to https? (?:www )?unlicense org"),
    ("cc0-1.0", "deed", 0.95, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "neighboring", 0.9, "waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "creativecommons", 0.95, "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", "creativecommons", 0.95, "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons", 0.9, "creativecommons org licenses by(?! nc| nd| sa| 3| 4)"),
    ("cc-by-3.0", "creativecommons", 0.95, "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creativecommons", 0.95, "creativecommons org licenses by 4 0"),
    ("cc-by-sa", "creativecommons", 0.95, "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons", 0.95, "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons", 0.95, "creativecommons org licenses by nc(?: [1-4] [05])?(?! sa| nd)"),
    ("cc-by-nc-sa", "creativecommons", 0.95, "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons", 0.95, "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("artistic", "perl", 0.9, "under the same terms as (?:the )?perl (?:5 )?(?:itself|programming language system itself)"),
    ("artistic-1.0", "semblance", 0.95, "such that the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("wtfpl", "fuck", 0.95, "you just do what the fuck you want to"),
    ("beerware", "stuff", 0.95, "as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", "beer", 0.8, "you can buy me a beer in return"),
    ("openssl", "openssl", 0.95, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "ssl", 0.9, "this package is an ssl implementation written by eric young"),
    ("php-3.01", "php", 0.9, "this product includes php software freely available from"),
    ("psf-2.0", "psf", 0.95, "psf is making python available to licensee on an as is basis"),
    ("ruby", "modify", 0.8, "you may modify your copy of the software in any way provided that you do at least one of the following"),
    ("ofl-1.1", "font", 0.95, "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "font", 0.9, "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ms-pl", "infringed", 0.9, "if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("eupl", "eupl", 0.9, "licensed under the eupl"),
    ("odbl", "database", 0.95, "this (?:\\S+ )?database is made available under the open database license"),
    ("pddl-1.0", "dedication", 0.9, "open data commons public domain dedication and licen[cs]e"),
    ("odc-by-1.0", "commons", 0.9, "open data commons attribution license"),
    ("sspl-1.0", "functionality", 0.9, "make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "production", 0.9, "the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "hosted", 0.9, "you may not provide the software to third parties as a hosted or managed service"),
    ("elastic-2.0", "elastic", 0.9, "elastic license 2 0"),
    ("commons-clause", "sell", 0.9, "the license does not include and the license does not grant to you the right to sell the software"),
    ("polyform-nc-1.0", "polyform", 0.9, "polyform noncommercial license(?: 1 0 0)?"),
    ("json", "evil", 0.95, "the software shall be used for good not evil"),
    ("unicode-dfs", "unicode", 0.9, "any person obtaining a copy of the unicode data files and any associated documentation"),
    ("ncsa", "ncsa", 0.9, "university of illinois ncsa open source license"),
    ("afl-3.0", "academic", 0.9, "academic free license version 3 0"),
    ("ecl-2.0", "educational", 0.9, "educational community license version 2 0"),
    ("qpl-1.0", "q", 0.8, "the q public license(?: version)?(?: 1 0)?"),
    ("nasa-1.3", "nasa", 0.9, "nasa open source agreement version 1 3"),
    ("rpl-1.5", "reciprocal", 0.9, "reciprocal public license (?:version )?1 5"),
    ("mulanpsl-2.0", "mulan", 0.9, "mulan (?:permissive software license|psl) v ?2"),
    ("tcl", "hereby", 0.9, "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("ijg", "jpeg", 0.9, "this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", 0.9, "portions of this software are copyright (?:[12]\\d{3} )?the freetype project"),
    ("us-gov", "government", 0.8, "as a work of the united states government this (?:project|package|software) is in the public domain"),
    ("proprietary", "confidential", 0.8, "this software is the confidential and proprietary information of"),
    ("proprietary", "unauthorized", 0.8, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "reproduced", 0.7, "no part of this (?:publication|document|book) may be reproduced"),
    ("llama-community", "llama", 0.8, "llama (?:[234] (?:[123] )?)?community license agreement"),
    ("openrail", "rail", 0.8, "(?:creativeml )?open rail m license"),
    ("bigscience-rail-1.0", "bigscience", 0.8, "bigscience rail license(?: v ?1 0)?"),
]
#: Priority of signatures: above every notice, so that a license's text is one detection and not the names inside it.
TEXT_PRIORITY = 6

# Kinds of notice, with %s for a license's names or identifiers, their priority and confidence.
NOTICES = [
    ("spdx license identifier %s", "short", 5, 1.0),
    ("(?:is |are |be |released |distributed |made |available )*(?:licen[cs]ed|released|distributed|available|redistributed) under (?:the )?(?:terms of )?(?:the )?%s", "both", 4, 0.95),
    ("under the terms (?:and conditions )?of (?:the )?%s", "name", 4, 0.9),
    ("(?:subject to|governed by|covered by|see|refer to) (?:the )?%s", "name", 3, 0.8),
    ("%s", "name", 2, 0.7),
    ("%s", "short", 1, 0.5),
]


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    priority: int
    label: str
    confidence: float


def _sure_words(form: str) -> list[str]:
    """Words that stand as such in every match of a form."""
    form = re.sub(r"\(\?: [^()]*\)\?|\(\?! [^()]*\)", "", form)
    return [w for w in re.sub(r"\S+ \?\S+", "", form).split(" ") if w.isalnum()]


def _keyword(form: str, keyword: str) -> str:
    """The license's keyword where it is a word of every match, else the longest word that is."""
    words = _sure_words(form)
    return keyword if keyword in words else max(words, key=len)


def rules() -> list[Rule]:
    """The ordered rules: several hundred, highest priority first, then as in the tables."""
    out = [Rule(keyword, pattern, TEXT_PRIORITY, label, confidence) for label, keyword, confidence, pattern in SIGNATURES]
    for notice, which, priority, confidence in NOTICES:
        for label, keyword, names, short in LICENSES:
            words = {"name": names, "short": short, "both": names + short}[which]
            # A more precise label of the same family comes first in the table and so wins ties.
            for form in words:
                out.append(Rule(_keyword(form, keyword), notice % f"(?:{form})", priority, label, confidence))
    return out


_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RULES = "array<struct<pattern:string,priority:int,label:string,confidence:double,level:int,rank:int>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _any_word(words: list[str]) -> str:
    """A regular expression for any of the words between blanks, branching by first letter."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:1], []).append(re.escape(w[1:]))
    return "(?i) (?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(t)})" for c, t in tails.items()) + ") "


def scan(docs: DataFrame, ruleset: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, places, base_labels, detections, labels, score for each row of ``docs``.

    places: (word, label) for each place where a base phrase's words stand consecutively. detections: (first, last,
    priority, label, confidence) of the rules' word intervals that are not suppressed. labels: those of both, distinct
    and sorted. score: the highest confidence, 0 without a label. A null text is empty: no words, no labels. A null
    doc_id stays null, repeated rows stay, other columns are not read, an empty table gives an empty table.
    """
    ruleset = rules() if ruleset is None else ruleset
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), F.regexp_replace(text, _NOT_WORD, " "), F.lit(" ")).alias("s"))
    # Blanks of the text's own ends may double those added; one replace at each end settles it.
    spaced = spaced.select("doc_id", F.regexp_replace("s", "^ +| +$", "").alias("s"))
    n_words = F.when(F.col("s") == "", F.lit(0)).otherwise(F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit(""))) + 1).cast("long")
    # The keyword prefilter over the whole text: whole words of the ruleset and base phrases; (?i) folds A-Z only, as translate does.
    gate_words = sorted({r.keyword for r in ruleset} | {p.split(" ")[0] for p, _ in BASE_PHRASES})
    gate = F.rlike(F.concat(F.lit(" "), F.col("s"), F.lit(" ")), F.lit(_any_word(gate_words)))
    gated = spaced.select("doc_id", n_words.alias("n_words"), F.when(gate, F.translate("s", _UPPER, _LOWER)).alias("s"))
    words = F.when(F.col("s").isNotNull(), F.split("s", " "))
    staged = gated.select("doc_id", "n_words", "s", words.alias("w"))
    keys = F.array_intersect(F.col("w"), F.array(*[F.lit(k) for k in gate_words]))
    staged = staged.select("doc_id", "n_words", "w", keys.alias("keys"), F.when(F.size(keys) > 0, F.concat(F.lit(" "), F.col("s"), F.lit(" "))).alias("s"))

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")
        test = " and ".join(f"element_at(w, cast(i + {k + 1} as int)) = '{p}'" for k, p in enumerate(parts))
        return F.expr(f"""case when contains(s, ' {phrase} ') then transform(filter(sequence(0L, n_words - {len(parts)}L), i -> {test}),
            i -> struct(i as word, '{label}' as label)) end""")

    none = "cast(array() as array<struct<word:bigint,label:string>>)"
    based = staged.withColumn("places", F.concat(*[F.coalesce(places(p, x), F.expr(none)) for p, x in BASE_PHRASES]))

    # One literal, parsed when the plan is made: the rules of each keyword.
    levels = sorted({r.priority for r in ruleset})
    table: dict[str, list[dict]] = {}
    for rank, r in enumerate(ruleset):
        table.setdefault(r.keyword, []).append({**asdict(r), "pattern": f" {r.pattern}(?= )", "level": levels.index(r.priority), "rank": rank})
    by_keyword = F.from_json(F.lit(json.dumps(table)), f"map<string,{_RULES}>")
    based = based.withColumn("tried", F.when(F.size("keys") > 0, F.flatten(F.transform("keys", lambda k: F.coalesce(F.element_at(by_keyword, k), F.expr(f"cast(array() as {_RULES})"))))))
    # Where a rule's matches begin: blanks before, by the parts between matches and the matches before, added up along them.
    found = F.expr("""flatten(transform(filter(tried, r -> rlike(s, r.pattern)), r ->
        transform(aggregate(
            zip_with(split(s, r.pattern, -1), regexp_extract_all(s, r.pattern, 0), (a, b) -> struct(
                length(a) - length(replace(a, ' ', '')) as gap, length(b) - length(replace(b, ' ', '')) as n)),
            struct(0L as at, cast(array() as array<struct<first:bigint,n:bigint>>) as places),
            (acc, x) -> if(x.n is null, acc, struct(acc.at + x.gap + x.n as at, array_append(acc.places, struct(acc.at + x.gap as first, x.n * 1L as n)) as places)),
            acc -> acc.places),
            x -> struct(x.first as first, -(x.first + x.n - 1L) as back, -r.level as depth, r.rank as rank, r.priority as priority, r.label as label, r.confidence as confidence))))""")
    nothing = "cast(array() as array<struct<first:bigint,back:bigint,depth:int,rank:int,priority:int,label:string,confidence:double>>)"
    # In order of beginning, longest first, highest first: a detection is covered if an earlier one of its level or a higher reaches as far.
    based = based.withColumn("found", F.array_sort(F.coalesce(found, F.expr(nothing))))
    detections = F.expr(f"""aggregate(found,
        struct(transform(sequence(1, {max(len(levels), 1)}), k -> -1L) as reach, cast(array() as array<struct<first:bigint,last:bigint,priority:int,label:string,confidence:double>>) as kept),
        (acc, x) -> struct(
            transform(acc.reach, (r, k) -> if(k = -x.depth, greatest(r, -x.back), r)) as reach,
            if(array_max(slice(acc.reach, 1 - x.depth, {max(len(levels), 1)})) >= -x.back, acc.kept,
               array_append(acc.kept, struct(x.first as first, -x.back as last, x.priority as priority, x.label as label, x.confidence as confidence))) as kept),
        acc -> acc.kept)""")
    based = based.withColumn("detections", detections)
    base_labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p.label)))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p.label), F.transform("detections", lambda d: d.label))))
    top = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d.confidence)), F.lit(0.0)), F.when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return based.select("doc_id", "n_words", "places", base_labels.alias("base_labels"), "detections", labels.alias("labels"), top.alias("score"))
