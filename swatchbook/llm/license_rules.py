"""Signature rules of licences and notices, over texts reduced to lower-case words.

A rule is a regular expression over words set apart by one blank. Names and
their spellings are written by hand below; the usual ways to refer to a name
(a tag, a notice, a version, the bare name) are spelt out per name. Earlier
rules and lower priorities are more specific.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Priorities, best first, and how sure a detection of each is.
TAG, VERSIONED, NOTICE, NAME, HINT = range(5)
SURENESS = (0.99, 0.95, 0.9, 0.7, 0.3)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    pattern: str
    # Of each group any match holds a word; the pattern is tried only on texts that do.
    keywords: tuple[frozenset[str], ...]
    # All places of a base rule count, suppressed or not, and its label stays.
    base: bool = False


# Phrases of the contract.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# label, spelling of the name, versions ("" where the name has none). Spellings
# may use (?:..), | and ?; a word that every spelling holds is its keyword.
NAMES = (
    ("mit", r"(?:the )?mit licen[cs]e", ""),
    ("mit", r"expat licen[cs]e", ""),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", ""),
    ("apache", r"apache(?: software)?(?: foundation)? licen[cs]e", "1.0 1.1 2.0"),
    ("gpl", r"(?:gnu )?general public licen[cs]e", "1.0 2.0 3.0"),
    ("gpl", r"(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "2.0 2.1 3.0"),
    ("lgpl", r"(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "1.0 3.0"),
    ("agpl", r"(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3"),
    ("bsd-0-clause", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?", ""),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?", ""),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?", ""),
    ("bsd-4-clause", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?", ""),
    ("bsd", r"bsd(?: style)? licen[cs]e", ""),
    ("isc", r"isc licen[cs]e", ""),
    ("mpl", r"mozilla public licen[cs]e", "1.0 1.1 2.0"),
    ("mpl", r"mpl", "1.0 1.1 2.0"),
    ("epl", r"eclipse public licen[cs]e", "1.0 2.0"),
    ("epl", r"epl", "1.0 2.0"),
    ("edl", r"eclipse distribution licen[cs]e", "1.0"),
    ("cpl", r"common public licen[cs]e", "1.0"),
    ("ipl", r"ibm public licen[cs]e", "1.0"),
    ("cddl", r"common development and distribution licen[cs]e", "1.0 1.1"),
    ("cddl", r"cddl", "1.0 1.1"),
    ("cpal", r"common public attribution licen[cs]e", "1.0"),
    ("eupl", r"european union public licen[cs]e", "1.0 1.1 1.2"),
    ("eupl", r"eupl", "1.0 1.1 1.2"),
    ("artistic", r"artistic licen[cs]e", "1.0 2.0"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", ""),
    ("libpng", r"libpng licen[cs]e", "2.0"),
    ("bsl", r"boost software licen[cs]e", "1.0"),
    ("unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public licen[cs]e)", "1.0 2.0"),
    ("cc0", r"(?:creative commons zero|creative commons cc0|cc0|cc zero)(?: universal)?", "1.0"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|sharealike|share alike)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|noderivatives|noderivs|no derivatives)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike|share alike)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|noderivatives|noderivs|no derivatives)", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "1.0 2.0 2.5 3.0 4.0"),
    ("odbl", r"open (?:data commons open )?database licen[cs]e", "1.0"),
    ("odbl", r"odbl", "1.0"),
    ("odc-by", r"open data commons attribution licen[cs]e", "1.0"),
    ("pddl", r"(?:open data commons )?public domain dedication and licen[cs]e", "1.0"),
    ("cdla-permissive", r"community data licen[cs]e agreement permissive", "1.0 2.0"),
    ("cdla-sharing", r"community data licen[cs]e agreement sharing", "1.0"),
    ("ogl-uk", r"open government licen[cs]e", "1.0 2.0 3.0"),
    ("ofl", r"(?:sil )?open font licen[cs]e", "1.0 1.1"),
    ("psf", r"(?:python software foundation|psf) licen[cs]e", "2.0"),
    ("ruby", r"ruby licen[cs]e", ""),
    ("php", r"php licen[cs]e", "3.0 3.01"),
    ("postgresql", r"postgresql licen[cs]e", ""),
    ("openssl", r"openssl licen[cs]e", ""),
    ("json", r"json licen[cs]e", ""),
    ("curl", r"curl licen[cs]e", ""),
    ("ms-pl", r"microsoft public licen[cs]e", ""),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", ""),
    ("ncsa", r"(?:university of illinois )?(?:ncsa|university of illinois) open source licen[cs]e", ""),
    ("afl", r"academic free licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", r"open software licen[cs]e", "1.0 2.0 2.1 3.0"),
    ("ecl", r"educational community licen[cs]e", "1.0 2.0"),
    ("lppl", r"latex project public licen[cs]e", "1.0 1.1 1.2 1.3"),
    ("vim", r"vim licen[cs]e", ""),
    ("zpl", r"zope public licen[cs]e", "1.1 2.0 2.1"),
    ("qpl", r"q public licen[cs]e", "1.0"),
    ("sleepycat", r"sleepycat licen[cs]e", ""),
    ("apsl", r"apple public source licen[cs]e", "1.0 1.1 1.2 2.0"),
    ("cecill", r"cecill(?: free software)?(?: licen[cs]e(?: agreement)?)?", "1.0 1.1 2.0 2.1"),
    ("mulan-psl", r"mulan (?:psl|permissive software licen[cs]e)", "1.0 2.0"),
    ("nosl", r"netizen open source licen[cs]e", ""),
    ("upl", r"universal permissive licen[cs]e", "1.0"),
    ("w3c", r"w3c (?:software notice and |software and document )?licen[cs]e", ""),
    ("x11", r"x11 licen[cs]e", ""),
    ("ijg", r"independent jpeg group licen[cs]e", ""),
    ("icu", r"icu licen[cs]e", ""),
    ("unicode", r"unicode licen[cs]e", "3.0"),
    ("bittorrent", r"bittorrent open source licen[cs]e", "1.0 1.1"),
    ("sspl", r"server side public licen[cs]e", "1.0"),
    ("busl", r"business source licen[cs]e", "1.0 1.1"),
    ("elastic", r"elastic licen[cs]e", "1.0 2.0"),
    ("confluent", r"confluent community licen[cs]e", "1.0"),
    ("commons-clause", r"commons clause(?: licen[cs]e condition)?", "1.0"),
    ("polyform-noncommercial", r"polyform noncommercial licen[cs]e", "1.0"),
    ("polyform-shield", r"polyform shield licen[cs]e", "1.0"),
    ("parity", r"parity public licen[cs]e", "6.0 7.0"),
    ("prosperity", r"prosperity public licen[cs]e", "2.0 3.0"),
    ("hippocratic", r"hippocratic licen[cs]e", "1.0 2.0 2.1 3.0"),
    ("openrail", r"(?:bigscience )?open rail m? ?licen[cs]e", ""),
    ("openrail-m", r"openrail(?: m)?(?: licen[cs]e)?", ""),
    ("public-domain", r"(?:in|into|to) the public domain", ""),
)

# Sentences of licence texts and notices: name, label, priority, pattern, keywords.
SENTENCES = (
    ("mit grant", "mit", VERSIONED, r"permission is hereby granted free of charge to any person obtaining a copy", "permission hereby granted charge"),
    ("isc grant", "isc", VERSIONED, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission hereby granted fee"),
    ("bsd grant", "bsd", VERSIONED, r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary permitted"),
    ("bsd endorsement", "bsd-3-clause", VERSIONED, r"neither the names? of [^ ]+(?: [^ ]+){0,12} nor the names of its contributors may be used to endorse or promote", "neither contributors endorse"),
    ("bsd advertising", "bsd-4-clause", VERSIONED, r"all advertising materials mentioning features or use of this software must display", "advertising mentioning features"),
    ("apache grant", "apache-2.0", VERSIONED, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance", "apache licensed compliance"),
    ("apache address", "apache-2.0", TAG, r"apache org licenses license 2 0", "apache org licenses"),
    ("gpl freedom", "gpl", NOTICE, r"is free software you can redistribute it and or modify it under the terms of", "redistribute modify terms software"),
    ("gpl later", "gpl-or-later", NOTICE, r"either version [123](?: [0-9])? of the license or at your option any later version", "either version later option"),
    ("gpl warranty", "gpl", HINT, r"see the gnu (?:lesser |affero )?general public license for more details", "gnu general public details"),
    ("gpl address", "gpl", TAG, r"gnu org (?:licenses|copyleft) gpl", "gnu org gpl"),
    ("lgpl address", "lgpl", TAG, r"gnu org (?:licenses|copyleft) lgpl", "gnu org lgpl"),
    ("agpl address", "agpl", TAG, r"gnu org licenses agpl", "gnu org agpl"),
    ("mpl address", "mpl-2.0", TAG, r"mozilla org mpl 2 0", "mozilla org mpl"),
    ("mpl notice", "mpl-2.0", NOTICE, r"this source code form is subject to the terms of the mozilla public license v 2 0", "source form mozilla"),
    ("boost grant", "bsl-1.0", VERSIONED, r"distributed under the boost software license version 1 0", "boost distributed software"),
    ("zlib grant", "zlib", VERSIONED, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "authors held liable express"),
    ("unlicense grant", "unlicense", VERSIONED, r"this is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("cc address", "creative-commons", NAME, r"creativecommons org licenses", "creativecommons org licenses"),
    ("cc by address", "cc-by", TAG, r"creativecommons org licenses by [1-4] [05]", "creativecommons org by"),
    ("cc by sa address", "cc-by-sa", TAG, r"creativecommons org licenses by sa [1-4] [05]", "creativecommons org by sa"),
    ("cc by nc address", "cc-by-nc", TAG, r"creativecommons org licenses by nc [1-4] [05]", "creativecommons org by nc"),
    ("cc by nd address", "cc-by-nd", TAG, r"creativecommons org licenses by nd [1-4] [05]", "creativecommons org by nd"),
    ("cc by nc sa address", "cc-by-nc-sa", TAG, r"creativecommons org licenses by nc sa [1-4] [05]", "creativecommons org nc sa"),
    ("cc by nc nd address", "cc-by-nc-nd", TAG, r"creativecommons org licenses by nc nd [1-4] [05]", "creativecommons org nc nd"),
    ("cc0 address", "cc0", TAG, r"creativecommons org publicdomain zero 1 0", "creativecommons publicdomain zero"),
    ("cc name", "creative-commons", NAME, r"creative commons licen[cs]e", "creative commons"),
    ("cc some rights", "creative-commons", HINT, r"some rights reserved", "some rights reserved"),
    ("warranty", "warranty-disclaimer", HINT, r"as is (?:and )?without warrant(?:y|ies)(?: or conditions)? of any kind", "as is without kind"),
    ("warranty implied", "warranty-disclaimer", HINT, r"implied warranties of merchantability(?: and| or)? fitness for a particular purpose", "implied merchantability fitness"),
    ("copyright year", "copyright", HINT, r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?", "copyright"),
    ("copyright sign", "copyright", HINT, r"© (?:19|20)[0-9]{2}", "©"),
    ("confidential", "proprietary", NAME, r"(?:confidential and proprietary|proprietary and confidential)", "confidential proprietary"),
    ("no copying", "proprietary", NAME, r"unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|document|software|material)", "of this"),
    ("no permission", "proprietary", NAME, r"(?:may not|must not|cannot) be (?:reproduced|copied|distributed|republished)(?: [^ ]+){0,12} without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)", "not be without"),
    ("eula", "proprietary", NAME, r"end user licen[cs]e agreement", "end user agreement"),
    ("crown", "crown-copyright", NAME, r"crown copyright", "crown copyright"),
    ("fair use", "fair-use", HINT, r"fair (?:use|dealing) (?:act|exception|provision|under)", "fair"),
    ("used by permission", "by-permission", HINT, r"(?:used|reprinted|reproduced) (?:by|with) (?:kind )?permission", "permission"),
)

GNU = ("gpl", "lgpl", "agpl", "gfdl")
UNDER = r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|governed)(?: [^ ]+)? (?:under|by)(?: the)?(?: terms of)?(?: the)?(?: an?)?"
TAGGED = r"spdx licen[cs]e identifier"


def _keywords(pattern: str) -> tuple[frozenset[str], ...]:
    """Groups of words of which any match holds one each: plain words, both spellings, and a word per alternative."""
    flat, groups = pattern, set()

    def alternatives(match: re.Match) -> str:
        words = [max(re.findall(r"[a-z0-9]+", x), key=len, default="") for x in match[1].split("|")]
        if all(words):
            groups.add(frozenset(words))
        return " "

    # Optional parts go first, from the inside.
    while (plain := re.sub(r"\(\?:[^()]*\)\?|[^ ()|]\?", " ", flat)) != flat:
        flat = plain
    flat = re.sub(r"\(\?:([^()]*)\)", alternatives, flat)
    for word in flat.split():
        if word == "licen[cs]e":
            groups.add(frozenset(("license", "licence")))
        elif re.fullmatch(r"[a-z0-9]+", word):
            groups.add(frozenset((word,)))
    return tuple(sorted(groups, key=sorted))


def _all_of(words: str) -> tuple[frozenset[str], ...]:
    return tuple(frozenset((w,)) for w in words.split())


def _version(version: str) -> str:
    """``2.0`` as "2", "2 0", "v2 0", "version 2 0" and the like; "2.1" never as "2"."""
    major, _, minor = version.partition(".")
    rest = r"(?: 0)?" if minor == "0" else f" {minor}"
    return rf"(?: (?:only|or))?(?: version| v)? v?{major}{rest}(?! [0-9]+ )"


def _of_name(number: int, label: str, spelling: str, versions: str) -> list[Rule]:
    words = _keywords(spelling)
    rules = []
    for version in versions.split():
        named, either = f"{label}-{version}", spelling + _version(version)
        if label in GNU:
            later = rf"{either}(?: [^ ]+){{0,4}} or (?:\(at your option\) )?(?:any )?(?:later|newer)(?: version)?"
            rules.append(Rule(f"{number} {version} or later", f"{named}-or-later", VERSIONED, later, (*words, *_all_of("or"))))
        rules.append(Rule(f"{number} {version}", named, VERSIONED, either, words))
    rules.append(Rule(f"{number} notice", label, NOTICE, f"{UNDER} {spelling}", words))
    rules.append(Rule(f"{number} name", label, NAME, spelling, words))
    return rules


def _tags() -> list[Rule]:
    """Machine-readable tags: ``SPDX-License-Identifier: GPL-2.0-only`` and the like."""
    tags = sorted({(label, version) for label, _, versions in NAMES for version in versions.split() or [""]})
    rules = []
    for label, version in tags:
        words = " ".join([*label.split("-"), *version.replace(".", " ").split()])
        name = f"{label}-{version}" if version else label
        if label in GNU:
            rules.append(Rule(f"tag {name} later", f"{name}-or-later", TAG, rf"{TAGGED} {words} or later", _all_of(f"identifier {label}")))
        rules.append(Rule(f"tag {name}", name, TAG, rf"{TAGGED} {words}(?: only)?", _all_of("identifier " + label.split("-")[0])))
    return rules


def rules() -> list[Rule]:
    """All rules in order, base phrases last in each priority."""
    made = _tags()
    for number, (label, spelling, versions) in enumerate(NAMES):
        made += _of_name(number, label, spelling, versions)
    made += [Rule(name, label, priority, pattern, _all_of(words)) for name, label, priority, pattern, words in SENTENCES]
    made += [Rule(f"base {phrase}", label, NAME, phrase, _all_of(phrase), True) for phrase, label in BASE]
    return sorted(made, key=lambda r: r.priority)
