"""Known licence sentences and the rules over them; the tables are fixed values or made from them by rule."""

from __future__ import annotations

from itertools import product

#: Known sentences, normalised (fixed values); "*" stands for 1 to 12 words.
TEXTS = {
    "mit grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-0 grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit notice next": "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    "mit warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "boost grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsd grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd names": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd name": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "isc grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc grant old": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "hpnd grant": "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted",
    "apache header": "licensed under the apache license version 2 0 the license",
    "apache comply": "you may not use this file except in compliance with the license",
    "apache copy": "you may obtain a copy of the license at",
    "apache language": "see the license for the specific language governing permissions and limitations under the license",
    "apache asf": "licensed to the apache software foundation asf under one or more contributor license agreements",
    "apache terms": "terms and conditions for use reproduction and distribution",
    "apache patent": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "gnu verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-2 preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl-3 preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "agpl-3 preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "lgpl-3 preamble": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl-2.1 preamble": "this is the first released version of the lesser gpl",
    "lgpl-2 preamble": "this is the first released version of the library gpl",
    "gpl-1 preamble": "the license agreements of most software companies try to keep users at the mercy of those companies",
    "gnu safest convey": "it is safest to attach them to the start of each source file to most effectively convey the exclusion of warranty",
    "gnu safest state": "it is safest to attach them to the start of each source file to most effectively state the exclusion of warranty",
    "mpl-2 header": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2 copy": "if a copy of the mpl was not distributed with this file you can obtain one",
    "mpl-1.1 header": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "epl-1 header": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "epl-2 header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "cddl header": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "zlib warranty": "this software is provided as is without any express or implied warranty",
    "zlib grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "unlicense grant": "this is free and unencumbered software released into the public domain",
    "unlicense use": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "cc0 waiver": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "cc0 laws": "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights",
    "cc0 owners": "certain owners wish to permanently relinquish those rights to a work for the purpose of contributing to a commons of creative cultural and scientific works",
    "psf between": "this license agreement is between the python software foundation",
    "psf changes": "in the event licensee prepares a derivative work that is based on or incorporates python or any part thereof and wants to make the derivative work available to others as provided herein then licensee hereby agrees to include in any such work a brief summary of the changes made to python",
    "psf basis": "psf is making python available to licensee on an as is basis",
    "apache or bsd": "this software is made available under the terms of either of the licenses found in license apache or license bsd",
    "artistic": "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package",
    "ofl header": "this font software is licensed under the sil open font license version 1 1",
    "postgresql": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
}

#: Licences and what they are called after "licensed under" (fixed values).
NAMES = {
    "MIT": ["mit license", "mit", "expat license", "mit x11 license"],
    "MIT-0": ["mit 0", "mit no attribution license"],
    "X11": ["x11 license", "x11"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license", "apache 2 license", "apache license v2 0", "asl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd license"],
    "BSD-4-Clause": ["bsd 4 clause license", "bsd 4 clause", "original bsd license"],
    "ISC": ["isc license", "isc"],
    "0BSD": ["0bsd", "zero clause bsd license", "bsd zero clause license"],
    "Zlib": ["zlib license", "zlib"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license", "bsl 1 0"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "MPL-1.1": ["mozilla public license version 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license", "cddl 1 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license", "ofl 1 1"],
    "PostgreSQL": ["postgresql license", "postgresql"],
    "EUPL-1.2": ["european union public license version 1 2", "european union public licence version 1 2", "eupl 1 2"],
    "CC0-1.0": ["cc0 1 0", "cc0", "creative commons zero", "cc0 1 0 universal", "creative commons cc0 1 0 universal license"],
    "ODbL-1.0": ["open database license", "odbl 1 0", "odbl"],
    "PSF-2.0": ["python software foundation license", "psf 2 0"],
    "GFDL-1.3": ["gnu free documentation license version 1 3", "gnu free documentation license", "gfdl 1 3"],
}
#: The GNU family: prefix, short name, long name, versions (fixed values).
GNU = [
    ("GPL", "gpl", "gnu general public license", (("1.0", "1"), ("2.0", "2"), ("3.0", "3"))),
    ("LGPL", "lgpl", "gnu lesser general public license", (("2.1", "2 1"), ("3.0", "3"))),
    ("LGPL", "lgpl", "gnu library general public license", (("2.0", "2"),)),
    ("AGPL", "agpl", "gnu affero general public license", (("3.0", "3"),)),
]
#: Creative Commons: parts of the id with their words, and versions with what follows them (fixed values).
CC_PARTS = {"BY": "attribution", "SA": "sharealike", "NC": "noncommercial", "ND": "noderivatives"}
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")
CC_VERSIONS = {"4.0": "international", "3.0": "unported", "2.5": "generic", "2.0": "generic"}
#: What goes before a name (fixed values).
SUBJECTS = ("", "this work is ", "this project is ", "this software is ", "this file is ", "this code is ", "this library is ", "this program is ", "this package is ", "this document is ", "the code is ", "all code is ", "code is ", "it is ", "dual ")
VERBS = ("licensed", "released", "distributed", "available", "made available", "published", "provided")
JOINTS = (" under ", " under the terms of ")
TAGS = ("spdx license identifier ", "license ", "licence ")
ARTICLES = ("", "the ", "a ", "an ")


def gnu_names() -> dict[str, list[str]]:
    """Names of GNU licences; one without "or later" or "only" is the bare licence."""
    found: dict[str, list[str]] = {}
    for prefix, short, long, versions in GNU:
        for number, words in versions:
            plain = [f"{long} version {words}", f"{long} v{words}", f"{short} {words}", f"{short} v{words}", f"{short} version {words}", f"{short}v{words}", f"{prefix} {number}".lower().replace(".", " ")]
            found.setdefault(f"{prefix}-{number}", []).extend(dict.fromkeys(plain))
            for tail, kind in ((" or later", "or-later"), (" or any later version", "or-later"), (" only", "only")):
                found.setdefault(f"{prefix}-{number}-{kind}", []).extend(dict.fromkeys(p + tail for p in plain))
    return found


def cc_names() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for kind, (version, kind_words) in product(CC_KINDS, CC_VERSIONS.items()):
        number = version.replace(".", " ")
        short = f"cc {kind.lower().replace('-', ' ')} {number}"
        long = f"creative commons {' '.join(CC_PARTS[p] for p in kind.split('-'))} {number}"
        found[f"CC-{kind}-{version}"] = [short, f"{short} license", f"{long} {kind_words} license", f"{long} {kind_words}", f"{long} license", long]
    return found


def gnu_sentences() -> dict[str, str]:
    """The headers of programs and libraries under GNU licences."""
    found = {}
    for prefix, _, long, versions in GNU:
        for (number, words), what in product(versions, ("program", "library", "software", "file")):
            start = f"this {what} is free software you can redistribute it and or modify it under the terms of the {long}"
            found[f"{prefix}-{number}-or-later {what}"] = f"{start} as published by the free software foundation either version {words} of the license or at your option any later version"
            found[f"{prefix}-{number}-only {what}"] = f"{start} version {words} as published by the free software foundation"
            found[f"{prefix}-{number}-only {what} of"] = f"{start} as published by the free software foundation version {words} of the license"
    return found


SENTENCES = TEXTS | gnu_sentences()
PHRASES = [(license_id, name) for license_id, names in (NAMES | gnu_names() | cc_names()).items() for name in dict.fromkeys(names)]
PREFIXES = list(dict.fromkeys([s + v + j for s, v, j in product(SUBJECTS, VERBS, JOINTS)] + list(TAGS)))
#: Identifiers, from 1: known sentences in their order, then the names.
SID = {key: n for n, key in enumerate(SENTENCES, 1)}
NAME_SID = {name: len(SENTENCES) + n for n, (_, name) in enumerate(PHRASES, 1)}

#: Rules of sentences that follow each other, in order (fixed values).
SEQUENCES = [
    ("BSD-4-Clause", ("bsd grant", "bsd source", "bsd binary", "bsd advertising", "bsd names")),
    ("BSD-3-Clause", ("bsd grant", "bsd source", "bsd binary", "bsd names")),
    ("BSD-3-Clause", ("bsd grant", "bsd source", "bsd binary", "bsd name")),
    ("BSD-2-Clause", ("bsd grant", "bsd source", "bsd binary")),
    ("Apache-2.0", ("apache header", "apache comply", "apache copy", "apache language")),
    ("Apache-2.0", ("apache header", "apache comply")),
    ("Apache-2.0", ("apache asf", "apache comply")),
    ("Apache-2.0", ("apache terms", "apache patent")),
    ("MIT", ("mit grant", "mit notice")),
    ("MIT", ("mit grant", "mit notice next")),
    ("MIT-0", ("mit-0 grant", "mit warranty")),
    ("ISC", ("isc grant", "isc warranty")),
    ("0BSD", ("0bsd grant", "isc warranty")),
    ("LGPL-2.1", ("gnu verbatim", "lgpl-2.1 preamble", "gpl-2 preamble")),
    ("LGPL-2.0", ("gnu verbatim", "lgpl-2 preamble", "gpl-2 preamble")),
    ("LGPL-2.1", ("lgpl-2.1 preamble", "gpl-2 preamble")),
    ("LGPL-2.0", ("lgpl-2 preamble", "gpl-2 preamble")),
    ("GPL-1.0", ("gnu verbatim", "gpl-1 preamble")),
    ("GPL-2.0", ("gnu verbatim", "gpl-2 preamble")),
    ("GPL-3.0", ("gnu verbatim", "gpl-3 preamble")),
    ("AGPL-3.0", ("gnu verbatim", "agpl-3 preamble")),
    ("LGPL-3.0", ("gnu verbatim", "lgpl-3 preamble")),
    ("LGPL-2.1", ("gnu verbatim", "lgpl-2.1 preamble")),
    ("LGPL-2.0", ("gnu verbatim", "lgpl-2 preamble")),
    ("CC0-1.0", ("cc0 laws", "cc0 owners")),
    ("PSF-2.0", ("psf between", "psf changes", "psf basis")),
    ("PSF-2.0", ("psf between", "psf changes")),
    ("MPL-2.0", ("mpl-2 header", "mpl-2 copy")),
    ("Zlib", ("zlib warranty", "zlib grant", "zlib origin")),
    ("Unlicense", ("unlicense grant", "unlicense use")),
]
#: Sentences that tell a licence by themselves (fixed values).
SINGLES = [
    ("MIT", "mit grant"), ("BSL-1.0", "boost grant"), ("Apache-2.0", "apache header"), ("Apache-2.0", "apache patent"), ("ISC", "isc grant"), ("ISC", "isc grant old"), ("HPND", "hpnd grant"),
    ("GPL-2.0", "gpl-2 preamble"), ("GPL-3.0", "gpl-3 preamble"), ("AGPL-3.0", "agpl-3 preamble"), ("LGPL-3.0", "lgpl-3 preamble"), ("LGPL-2.1", "lgpl-2.1 preamble"), ("MPL-2.0", "mpl-2 header"), ("MPL-1.1", "mpl-1.1 header"), ("EPL-1.0", "epl-1 header"), ("EPL-2.0", "epl-2 header"),
    ("CDDL-1.0", "cddl header"), ("Zlib", "zlib grant"), ("Unlicense", "unlicense grant"), ("WTFPL", "wtfpl"), ("CC0-1.0", "cc0 waiver"), ("CC0-1.0", "cc0 owners"), ("PSF-2.0", "psf between"), ("LGPL-2.0", "lgpl-2 preamble"), ("GPL-1.0", "gpl-1 preamble"), ("Apache-2.0 OR BSD-2-Clause", "apache or bsd"), ("Artistic-1.0", "artistic"), ("OFL-1.1", "ofl header"), ("PostgreSQL", "postgresql"),
]



def gnu_appendices() -> list[tuple[str, tuple[str, str]]]:
    """Headers that a licence's own text shows for others to use; they tell that licence, without "or later"."""
    return [(key.split("-or-later")[0], (advice, key)) for key in gnu_sentences() if key.endswith(("or-later program", "or-later library")) for advice in ("gnu safest convey", "gnu safest state")]


#: Rules in order: licence, identifiers.
RULES = (
    [(license_id, tuple(SID[k] for k in keys)) for license_id, keys in SEQUENCES + gnu_appendices()]
    + [(license_id, (SID[key],)) for license_id, key in SINGLES]
    + [(key.split(" ")[0], (SID[key],)) for key in gnu_sentences()]
    + [(license_id, (NAME_SID[name],)) for license_id, name in PHRASES]
)
