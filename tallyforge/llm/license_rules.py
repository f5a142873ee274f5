"""Ordered signature rules for licence notices.

Rules match a text's words, lower-cased and joined by single spaces, so punctuation and
line breaks never hide a notice.  The rule list is built from families (a label, a
pattern for its name, a word every such name contains) times the forms in which
licences are named, plus signatures of licence texts.  Order: a higher priority wins.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    label: str
    priority: int
    weight: float
    keyword: str
    pattern: re.Pattern


_V = r"(?: licen[cs]e)?(?: version| ?v)?"

#: label, pattern of the name, keyword
FAMILIES = (
    ("mit", r"(?:mit|expat)", "mit|expat"),
    ("mit-0", r"mit no attribution", "attribution"),
    ("x11", r"x11", "x11"),
    ("isc", r"isc", "isc"),
    ("0bsd", r"(?:0bsd|(?:bsd )?zero clause(?: bsd)?)", "0bsd|zero"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "bsd|freebsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("bsd", r"bsd(?: style)?", "bsd"),
    ("apache-1.0", rf"apache(?: software)?{_V} 1 0", "apache"),
    ("apache-1.1", rf"apache(?: software)?{_V} 1 1", "apache"),
    ("apache-2.0", rf"apache(?: software)?{_V} 2(?: 0)?", "apache"),
    ("apache", r"apache(?: software)?", "apache"),
    ("gpl-1.0", rf"(?:gnu )?(?:gpl|general public){_V} ?1(?: 0)?", "gpl|general"),
    ("gpl-2.0", rf"(?:gnu )?(?:gpl|general public){_V} ?2(?: 0)?", "gpl|general"),
    ("gpl-3.0", rf"(?:gnu )?(?:gpl|general public){_V} ?3(?: 0)?", "gpl|general"),
    ("gpl", r"(?:gnu )?(?:gpl|general public)", "gpl|general"),
    ("lgpl-2.0", rf"(?:gnu )?(?:lgpl|(?:lesser|library) general public){_V} ?2(?: 0)?", "lgpl|lesser|library"),
    ("lgpl-2.1", rf"(?:gnu )?(?:lgpl|lesser general public){_V} ?2 1", "lgpl|lesser"),
    ("lgpl-3.0", rf"(?:gnu )?(?:lgpl|lesser general public){_V} ?3(?: 0)?", "lgpl|lesser"),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public)", "lgpl|lesser|library"),
    ("agpl-1.0", rf"(?:affero general public|agpl){_V} ?1(?: 0)?", "agpl|affero"),
    ("agpl-3.0", rf"(?:gnu )?(?:agpl|affero general public){_V} ?3(?: 0)?", "agpl|affero"),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public)", "agpl|affero"),
    ("gfdl", r"(?:gnu )?(?:gfdl|free documentation)", "gfdl|documentation"),
    ("mpl-1.0", rf"(?:mpl|mozilla public){_V} 1 0", "mpl|mozilla"),
    ("mpl-1.1", rf"(?:mpl|mozilla public){_V} 1 1", "mpl|mozilla"),
    ("mpl-2.0", rf"(?:mpl|mozilla public){_V} 2(?: 0)?", "mpl|mozilla"),
    ("mpl", r"(?:mpl|mozilla public)", "mpl|mozilla"),
    ("epl-1.0", rf"(?:epl|eclipse public){_V} 1(?: 0)?", "epl|eclipse"),
    ("epl-2.0", rf"(?:epl|eclipse public){_V} 2(?: 0)?", "epl|eclipse"),
    ("epl", r"(?:epl|eclipse public)", "epl|eclipse"),
    ("edl-1.0", r"eclipse distribution", "eclipse"),
    ("eupl-1.1", rf"(?:eupl|european union public){_V} 1 1", "eupl|european"),
    ("eupl-1.2", rf"(?:eupl|european union public){_V} 1 2", "eupl|european"),
    ("eupl", r"(?:eupl|european union public)", "eupl|european"),
    ("cddl-1.0", rf"(?:cddl|common development and distribution){_V} 1 0", "cddl|common"),
    ("cddl-1.1", rf"(?:cddl|common development and distribution){_V} 1 1", "cddl|common"),
    ("cddl", r"(?:cddl|common development and distribution)", "cddl|common"),
    ("cpl-1.0", r"(?:cpl|common public)(?: 1 0)?", "cpl|common"),
    ("cpal-1.0", r"(?:cpal|common public attribution)(?: 1 0)?", "cpal|attribution"),
    ("cc0-1.0", r"(?:cc0(?: 1 0)?|creative commons zero)", "cc0|zero"),
    ("cc-by-2.0", rf"(?:cc by|creative commons attribution){_V} 2 0", "by|attribution"),
    ("cc-by-3.0", rf"(?:cc by|creative commons attribution){_V} 3 0", "by|attribution"),
    ("cc-by-4.0", rf"(?:cc by|creative commons attribution){_V} 4 0", "by|attribution"),
    ("cc-by-sa-3.0", rf"(?:cc by sa|creative commons attribution share ?alike){_V} 3 0", "sa|sharealike|share"),
    ("cc-by-sa-4.0", rf"(?:cc by sa|creative commons attribution share ?alike){_V} 4 0", "sa|sharealike|share"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?derivatives)", "nd|noderivatives|derivatives"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "nc|noncommercial|commercial"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?derivatives)", "nc|noncommercial|commercial"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "nc|noncommercial|commercial"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "by|attribution"),
    ("odbl-1.0", r"(?:odbl|open database)(?: 1 0)?", "odbl|database"),
    ("odc-by", r"(?:odc by|open data commons attribution)", "odc|commons"),
    ("pddl-1.0", r"(?:pddl|public domain dedication and)", "pddl|dedication"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl|want"),
    ("zlib", r"zlib(?: libpng)?", "zlib"),
    ("libpng", r"libpng", "libpng"),
    ("artistic-1.0", r"(?:perl )?artistic 1 0", "artistic"),
    ("artistic-2.0", rf"artistic{_V} 2(?: 0)?", "artistic"),
    ("artistic", r"artistic", "artistic"),
    ("afl-3.0", r"(?:afl 3 0|academic free(?: license)?(?: version)? 3 0)", "afl|academic"),
    ("afl", r"(?:afl|academic free)", "afl|academic"),
    ("osl-3.0", r"(?:osl|open software) 3 0", "osl|open"),
    ("osl", r"(?:osl|open software)", "osl|open"),
    ("bsl-1.0", r"boost(?: software)?(?: 1 0)?", "boost"),
    ("busl-1.1", r"(?:busl 1 1|business source)", "busl|business"),
    ("sspl-1.0", r"(?:sspl|server side public)", "sspl|server"),
    ("elastic-2.0", r"elastic(?: 2 0)?", "elastic"),
    ("python-2.0", r"(?:python software foundation|psf|python)(?: 2(?: 0)?)?", "psf|python"),
    ("php-3.01", r"php(?: 3 01| 3 0)?", "php"),
    ("ruby", r"ruby", "ruby"),
    ("openssl", r"openssl", "openssl"),
    ("postgresql", r"postgresql", "postgresql"),
    ("ms-pl", r"(?:ms pl|microsoft public)", "pl|microsoft"),
    ("ms-rl", r"(?:ms rl|microsoft reciprocal)", "rl|microsoft"),
    ("ncsa", r"(?:ncsa|university of illinois ncsa open source)", "ncsa"),
    ("ofl-1.1", r"(?:ofl|sil open font)(?: 1 1)?", "ofl|font"),
    ("upl-1.0", r"(?:upl|universal permissive)(?: 1 0)?", "upl|universal"),
    ("w3c", r"w3c(?: software)?", "w3c"),
    ("ecl-2.0", r"(?:ecl|educational community)(?: 2 0)?", "ecl|educational"),
    ("vim", r"vim", "vim"),
    ("json", r"json", "json"),
    ("beerware", r"beer ?ware", "beerware|beer"),
    ("qpl-1.0", r"(?:qpl|q public)(?: 1 0)?", "qpl|q"),
    ("ipl-1.0", r"(?:ipl|ibm public)(?: 1 0)?", "ipl|ibm"),
    ("apsl-2.0", r"(?:apsl|apple public source)(?: 2 0)?", "apsl|apple"),
    ("cecill-2.1", r"cecill(?: 2 1)?", "cecill"),
    ("mulan-psl-2.0", r"mulan(?: psl)?(?: v2| 2 0)?", "mulan"),
    ("openrail", r"(?:bigscience )?(?:open ?rail|rail)(?: m)?", "openrail|rail"),
    ("llama-community", r"llama(?: \d)?(?: community)?", "llama"),
)

#: Forms in which a family is named: form, priority, weight, pattern around the name.
FORMS = (
    ("tag", 80, 0.95, r"\bspdx license identifier {}\b"),
    # "Published by Apache" grants nothing: without "under", the word licence must follow.
    ("grant", 60, 0.9, r"\b(?:licensed|released|distributed|available|published|provided|covered)"
     r" (?:under(?: the)?(?: terms of(?: the)?)? {0}(?: licen[cs]e)?"
     r"|(?:by|with)(?: the)?(?: terms of(?: the)?)? {0} licen[cs]e)\b"),
    ("name", 40, 0.8, r"\b(?:the )?{} licen[cs]es?\b"),
)

#: Signatures of licence texts and notices: label, priority, weight, keyword, pattern.
TEXTS = (
    ("mit", 100, 0.99, "hereby", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"),
    ("isc", 100, 0.99, "copy", r"\bpermission to use copy modify and or distribute this software for any purpose\b"),
    ("bsd-4-clause", 95, 0.95, "acknowledgement", r"\ball advertising materials mentioning features or use of this software\b"),
    ("bsd-3-clause", 95, 0.95, "endorse", r"\bmay (?:not )?be used to endorse or promote products derived from\b"),
    ("bsd", 90, 0.95, "redistribution", r"\bredistribution and use in source and binary forms with or without\b"),
    ("gpl", 100, 0.99, "redistribute", r"\byou can redistribute it and or modify it under the terms of the gnu general public\b"),
    ("lgpl", 105, 0.99, "lesser", r"\byou can redistribute it and or modify it under the terms of the gnu lesser general public\b"),
    ("agpl", 105, 0.99, "affero", r"\byou can redistribute it and or modify it under the terms of the gnu affero general public\b"),
    ("apache-2.0", 100, 0.99, "compliance", r"\byou may not use this (?:file|work) except in compliance with the license\b"),
    ("mpl-2.0", 100, 0.99, "mozilla", r"\bthis source code form is subject to the terms of the mozilla public license\b"),
    ("unlicense", 100, 0.99, "unencumbered", r"\bthis is free and unencumbered software released into the public domain\b"),
    ("zlib", 100, 0.99, "misrepresented", r"\bthe origin of this software must not be misrepresented\b"),
    ("bsl-1.0", 100, 0.99, "boost", r"\bdistributed under the boost software license\b"),
    ("wtfpl", 100, 0.99, "want", r"\byou just do what the fuck you want to\b"),
    ("cc0-1.0", 100, 0.95, "waived", r"\bhas waived all copyright and related or neighboring rights\b"),
    ("public-domain", 50, 0.8, "domain", r"\b(?:in|into|to) the public domain\b"),
    ("all-rights-reserved", 30, 0.6, "reserved", r"\ball rights reserved\b"),
    ("proprietary", 30, 0.6, "confidential", r"\b(?:proprietary and confidential|confidential and proprietary)\b"),
    ("copyright-notice", 20, 0.5, "copyright", r"\bcopyright (?:c )?(?:19|20)\d\d\b"),
)

#: A text in which none of these stands holds no notice; tried before any pattern.
ROOTS = (
    "licen", "reserved", "copyright", "spdx", "hereby", "domain", "redistribut",
    "proprietary", "advertising", "endorse", "misrepresented", "unencumbered", "waived",
    "purpose", "want to", "released", "distributed", "available", "published", "provided",
    "covered",
)


def build_rules() -> list[Rule]:
    """All rules by falling priority; a longer family name goes before a shorter one."""
    rules = [
        Rule(f"{label}:text{i}", label, priority, weight, word, re.compile(pattern))
        for i, (label, priority, weight, word, pattern) in enumerate(TEXTS)
    ]
    for label, name, keyword in FAMILIES:
        for form, priority, weight, around in FORMS:
            pattern = re.compile(around.format(f"(?:{name})"))
            for word in keyword.split("|"):
                rules.append(Rule(f"{label}:{form}", label, priority, weight, word, pattern))
    return sorted(rules, key=lambda r: (-r.priority, r.name, r.keyword))
