"""Signature rules of licences, over lower-case words joined by single spaces.

A rule is a regular expression that begins with a literal word and matches whole words. Rules
are written by hand in three lists: families with their names and versions, sentences of licence texts,
and notices. A family makes a rule for its names, one for each version, and the same after
words that put something under the licence.

Levels say how much a rule tells, least first: 0 a grant or a licence's own text, 1 a licence with
its version, 2 a licence by name, 3 a notice or a mention.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as constants
from re import _parser as parser

GRANT, VERSION, NAME, NOTICE = range(4)
SCORES = {GRANT: 0.95, VERSION: 0.85, NAME: 0.7, NOTICE: 0.4}


@dataclass(frozen=True)
class Rule:
    label: str
    level: int
    regex: str  #: of whole words; without the space after the last
    base: bool = False  #: stays, whatever holds it

    @property
    def need(self) -> str:
        """Letters that whatever matches must hold: the longest that the regex spells out."""
        runs, now = [""], ""
        for op, value in parser.parse(self.regex):
            now = now + chr(value) if op is constants.LITERAL else ""
            runs.append(now)
        return max(runs, key=len).strip()

    @property
    def openings(self) -> list[str]:
        """What a match begins with: its first two words, or the first where the second is open."""
        found = set()
        for said in spelled([""], list(parser.parse(self.regex))):
            first, *rest = said.split(" ")
            if OPEN in first:
                raise ValueError(f"a rule must begin with a literal word: {self.regex}")
            found.add(f"{first} {rest[0]}" if rest and OPEN not in rest[0] else first)
        return sorted(found)


OPEN = "\0"  #: stands for what may be many things


def spelled(heads: list[str], parts: list) -> list[str]:
    """The texts that heads go on with, up to the second space or to what may be many things."""
    for op, value in parts:
        done = [h for h in heads if OPEN in h or h.count(" ") > 1]
        on = [h for h in heads if not (OPEN in h or h.count(" ") > 1)]
        if not on:
            return done
        if op is constants.LITERAL:
            on = [h + chr(value) for h in on]
        elif op is constants.IN and all(x is constants.LITERAL for x, _ in value):
            on = [h + chr(c) for h in on for _, c in value]
        elif op is constants.SUBPATTERN:
            on = spelled(on, list(value[3]))
        elif op is constants.BRANCH:
            on = [x for way in value[1] for x in spelled(on, list(way))]
        elif op is constants.MAX_REPEAT and value[:2] == (0, 1):
            on = on + spelled(on, list(value[2]))
        else:
            on = [h + OPEN for h in on]
        heads = done + on
    return heads


L = "licen[sc]e"

#: Label, names (each begins with a literal word), versions.
FAMILIES = [
    ("gpl", [f"gnu general public {L}", f"general public {L}", "gnu gpl", "gpl"], ["1", "2", "3"]),
    ("lgpl", [f"gnu lesser general public {L}", f"gnu library general public {L}", f"lesser general public {L}", f"library general public {L}", "gnu lgpl", "lgpl"], ["2", "2.1", "3"]),
    ("agpl", [f"gnu affero general public {L}", f"affero general public {L}", "gnu agpl", "agpl"], ["1", "3"]),
    ("gfdl", [f"gnu free documentation {L}", f"free documentation {L}", "gnu fdl", "gfdl"], ["1.1", "1.2", "1.3"]),
    ("apache", [f"apache software {L}", f"apache {L}", f"asf {L}", "apache"], ["1", "1.1", "2"]),
    ("mit", [f"mit x11 {L}", f"mit {L}", "mit expat", f"expat {L}", f"x11 {L}"], []),
    ("mit-0", [f"mit no attribution {L}", "mit no attribution", "mit 0"], []),
    ("bsd-0-clause", ["zero clause bsd", "bsd zero clause", "0 clause bsd", "bsd 0 clause", "0bsd"], []),
    ("bsd-1-clause", ["one clause bsd", "1 clause bsd", "bsd 1 clause"], []),
    ("bsd-2-clause", ["two clause bsd", "2 clause bsd", "bsd 2 clause", f"simplified bsd {L}", f"freebsd {L}"], []),
    ("bsd-3-clause", ["three clause bsd", "3 clause bsd", "bsd 3 clause", f"new bsd {L}", f"revised bsd {L}", f"modified bsd {L}"], []),
    ("bsd-4-clause", ["four clause bsd", "4 clause bsd", "bsd 4 clause", f"original bsd {L}", f"old bsd {L}"], []),
    ("bsd", [f"bsd style {L}", f"bsd {L}", f"berkeley software distribution {L}"], []),
    ("bsd-protection", [f"bsd protection {L}"], []),
    ("isc", [f"isc {L}", f"internet systems consortium {L}"], []),
    ("zlib", ["zlib libpng", f"zlib {L}", f"libpng {L}"], ["2"]),
    ("boost", [f"boost software {L}", f"boost {L}", "bsl"], ["1"]),
    ("unlicense", ["unlicense"], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["1", "2"]),
    ("beerware", [f"beerware {L}", f"beer ware {L}"], []),
    ("mpl", [f"mozilla public {L}", "mpl"], ["1", "1.1", "2"]),
    ("npl", [f"netscape public {L}"], ["1", "1.1"]),
    ("epl", [f"eclipse public {L}", "epl"], ["1", "2"]),
    ("edl", [f"eclipse distribution {L}"], ["1"]),
    ("cpl", [f"common public {L}"], ["1"]),
    ("ipl", [f"ibm public {L}"], ["1"]),
    ("cddl", [f"common development and distribution {L}", "cddl"], ["1", "1.1"]),
    ("cpal", [f"common public attribution {L}", "cpal"], ["1"]),
    ("eupl", [f"european union public {L}", "eupl"], ["1", "1.1", "1.2"]),
    ("cecill", ["cecill b", "cecill c", "cecill"], ["1", "1.1", "2", "2.1"]),
    ("artistic", [f"clarified artistic {L}", f"perl artistic {L}", f"artistic {L}"], ["1", "2"]),
    ("perl", ["same terms as perl itself", "same terms as the perl 5"], []),
    ("php", [f"php {L}"], ["3", "3.01"]),
    ("python", [f"python software foundation {L}", f"psf {L}", f"python {L}"], ["2"]),
    ("ruby", [f"ruby {L}", f"ruby s {L}"], []),
    ("openssl", [f"openssl {L}", f"ssleay {L}"], []),
    ("postgresql", [f"postgresql {L}"], []),
    ("curl", [f"curl {L}"], []),
    ("ncsa", [f"university of illinois ncsa open source {L}", f"ncsa open source {L}", f"ncsa {L}"], []),
    ("w3c", [f"w3c software notice and {L}", f"w3c software {L}", f"w3c {L}"], []),
    ("afl", [f"academic free {L}"], ["1.1", "1.2", "2", "2.1", "3"]),
    ("osl", [f"open software {L}"], ["1", "1.1", "2", "2.1", "3"]),
    ("ecl", [f"educational community {L}"], ["1", "2"]),
    ("upl", [f"universal permissive {L}"], ["1"]),
    ("ms-pl", [f"microsoft public {L}", "ms pl"], []),
    ("ms-rl", [f"microsoft reciprocal {L}", "ms rl"], []),
    ("qpl", [f"q public {L}"], ["1"]),
    ("sleepycat", [f"sleepycat {L}"], []),
    ("sspl", [f"server side public {L}", "sspl"], ["1"]),
    ("busl", [f"business source {L}", "busl"], ["1.1"]),
    ("elastic", [f"elastic {L}"], ["2"]),
    ("commons-clause", [f"commons clause {L} condition", "commons clause"], ["1"]),
    ("mulan", [f"mulan permissive software {L}", f"mulan psl"], ["1", "2"]),
    ("vim", [f"vim {L}"], []),
    ("unicode", [f"unicode {L}", f"unicode data files and software {L}"], ["3"]),
    ("ofl", [f"sil open font {L}", f"open font {L}", "sil ofl"], ["1", "1.1"]),
    ("odbl", [f"open data commons open database {L}", f"open database {L}", "odbl"], ["1"]),
    ("odc-by", [f"open data commons attribution {L}", "odc by"], ["1"]),
    ("pddl", [f"public domain dedication and {L}", "pddl"], ["1"]),
    ("ogl", [f"open government {L}"], ["1", "2", "3"]),
    ("etalab", ["licence ouverte", "etalab"], ["1", "2"]),
    ("dl-de", ["datenlizenz deutschland"], ["2"]),
    ("openrail", ["creativeml open rail m", "bigscience openrail m", "bigscience rail", "openrail m", "openrail"], ["1"]),
    ("llama", [f"llama 2 community {L}", f"llama 3 community {L}", f"llama community {L}"], []),
    ("gemma", ["gemma terms of use"], []),
    ("cc0", ["creative commons zero", "cc zero", "cc0"], ["1"]),
    ("cc-pdm", ["creative commons public domain mark", "public domain mark"], ["1"]),
    ("cc-by", ["creative commons attribution", "cc by"], ["1", "2", "2.5", "3", "4"]),
    ("cc-by-sa", ["creative commons attribution share ?alike", "cc by sa"], ["1", "2", "2.5", "3", "4"]),
    ("cc-by-nd", ["creative commons attribution no ?deriv(?:ative)?s", "cc by nd"], ["1", "2", "2.5", "3", "4"]),
    ("cc-by-nc", ["creative commons attribution non ?commercial", "cc by nc"], ["1", "2", "2.5", "3", "4"]),
    ("cc-by-nc-sa", ["creative commons attribution non ?commercial share ?alike", "cc by nc sa"], ["1", "2", "2.5", "3", "4"]),
    ("cc-by-nc-nd", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc by nc nd"], ["1", "2", "2.5", "3", "4"]),
]

#: What puts something under a licence.
UNDER = "(?:licensed|licenced|released|distributed|available|published|provided|offered|covered|governed|redistributed|dual licensed|made available) (?:under|by) (?:both )?(?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?"
SUFFIX = f"(?: international| unported| generic)?(?: public)?(?: {L})?"
LATER = "(?: only| or later| plus| or at your option any later version| or any later version)?"

#: Label, sentence.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of [a-z0-9]{1,40}(?: [a-z0-9]{1,40})?(?: [a-z0-9]{1,40})?(?: [a-z0-9]{1,40})? nor the names of its contributors"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public"),
    ("agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("mpl", "source code form is subject to the terms of the mozilla public"),
    ("epl", "accompanying materials are made available under the terms of the eclipse public"),
    ("cddl", "contents of this file are subject to the terms of the common development and distribution"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software must not be misrepresented"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("beerware", "buy me a beer in return"),
    ("ofl", "font software is licensed under the sil open font"),
    ("cc0", "waive all copyright and related or neighboring rights"),
    ("cc0", "person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("artistic", "standard version refers to such a package if it has not been modified"),
    ("public-domain", "released (?:in|into|to) the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "placed in the public domain"),
    ("proprietary", "(?:unauthorized|unauthorised) (?:copying|reproduction|use|distribution|duplication) of this"),
    ("proprietary", "(?:unauthorized|unauthorised) copying of this file via any medium is strictly prohibited"),
    ("proprietary", "confidential and proprietary"),
    ("proprietary", "no part of this (?:publication|book|work|document|material) may be reproduced"),
    ("proprietary", "not to be (?:copied|reproduced|distributed) without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent)"),
    ("proprietary", "reproduced with permission"),
    ("proprietary", "reprinted (?:with|by) permission"),
    ("non-commercial", "non ?commercial (?:use|purposes) only"),
    ("non-commercial", "for personal (?:and )?non ?commercial use"),
    ("non-commercial", "for research (?:use|purposes) only"),
    ("non-commercial", "for evaluation (?:use|purposes) only"),
    ("no-derivatives", "no derivative works? (?:is|are)? ?(?:allowed|permitted)"),
    ("no-warranty", "provided as is without (?:express or implied )?warrant(?:y|ies)"),
    ("no-warranty", "without warranty of any kind"),
    ("no-warranty", "without even the implied warranty of merchantability"),
    ("no-warranty", "absolutely no warranty"),
]

#: Label, phrase.
NOTICES = [
    ("reserved", "some rights reserved"),
    ("reserved", "no rights reserved"),
    ("reserved", "alle rechte vorbehalten"),
    ("reserved", "tous droits r[ée]serv[ée]s"),
    ("reserved", "todos los derechos reservados"),
    ("reserved", "todos os direitos reservados"),
    ("reserved", "tutti i diritti riservati"),
    ("copyright", "copyright(?: by| c)? (?:19|20)[0-9]{2}"),
    ("copyright", "copyright(?: by| c) [a-z0-9]{1,40}"),
    ("copyright", "copyright holders?"),
    ("copyright", "copyrighted (?:material|work|works|content)"),
    ("copyleft", "copyleft"),
    ("public-domain", "public domain"),
    ("trademark", "registered trademarks? of"),
    ("trademark", "(?:trademark|trademarks) of [a-z0-9]{1,40}"),
    ("patent", "patent pending"),
    ("terms", "terms (?:of use|of service|and conditions)"),
    ("terms", "end user licen[sc]e agreement"),
    ("terms", "eula"),
    ("creative-commons", "creative commons(?: licen[sc]e)?"),
    ("creative-commons", "creativecommons org licen[sc]es [a-z]{2}(?: [a-z]{2})?(?: [a-z]{2})?(?: [0-9])?(?: [0-9])?"),
    ("cc0", "creativecommons org publicdomain zero"),
    ("open-source", "open source (?:software|licen[sc]e)"),
    ("open-source", "osi approved(?: licen[sc]e)?"),
    ("free-software", "free software foundation"),
    ("spdx", "spdx licen[sc]e identifier [a-z0-9]{1,40}(?: [0-9](?: [0-9])?)?"),
    ("licensed", "licen[sc]ed (?:under|to)"),
    ("licensed", "see (?:the )?(?:accompanying )?(?:license|licence|copying|notice)(?: txt| md)? file"),
    ("licensed", "license agreement"),
]

#: Phrases that are kept wherever they stand, and their labels.
BASE = [("cc-by", "cc by", NAME), ("gpl", "general public license", NAME), ("reserved", "all rights reserved", NOTICE)]


#: Names that are other things, too, and tell a licence only with a version or a grant.
WORDS = {"apache", "etalab"}


def _numbered(version: str) -> str:
    whole, _, part = version.partition(".")
    return f"(?: {L})?(?: version| ver| v)? ?v?{whole}" + (f" {part}" if part else "(?: 0)?")


def rules() -> list[Rule]:
    """All rules in order: of equal levels and places the first one counts."""
    made = [Rule(label, level, phrase, base=True) for label, phrase, level in BASE]
    for label, names, versions in FAMILIES:
        either = lambda x: x[0] if len(x) == 1 else f"(?:{'|'.join(x)})"
        for version in versions:
            numbered = either(names) + _numbered(version) + SUFFIX + LATER
            made += [Rule(f"{label}-{version}", GRANT, UNDER + numbered), Rule(f"{label}-{version}", VERSION, numbered)]
            short = [f"{n}{v}{version[0]}" for n in names if n.isalpha() for v in ("", "v")]
            if short and (len(version) == 1):  # gplv3
                made.append(Rule(f"{label}-{version}", VERSION, either(short) + "(?: 0)?" + LATER))
        made.append(Rule(label, GRANT, UNDER + either(names) + SUFFIX + LATER))
        made.append(Rule(label, NAME, either([n for n in names if n not in WORDS])))
    made += [Rule(label, GRANT, sentence) for label, sentence in TEXTS]
    made += [Rule(label, NOTICE, phrase) for label, phrase in NOTICES]
    return made
