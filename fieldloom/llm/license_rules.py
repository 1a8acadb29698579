"""License scans by ordered signature rules over normalised words, as one column expression per row.

A text is lowered (A-Z), every run of characters outside words becomes one blank, and rules are regular expressions
over that form; each match starts with the blank before its first word, so blanks counted are words counted. Every match
of a rule and the blank after it hold the rule's two keywords: rules that miss one in a text do not run, and a text
without any first keyword is not scanned. Detections are ordered by start, longest first; one that lies inside an accepted
detection of the same or a higher priority is suppressed.

The rules are written by hand: signatures one by one (``SIGNATURES``), names of licenses as families, whose versions are
spelled out by a template for grants, tags and names (``rules``).

Defined results: null, empty and blank texts have no words and no labels (empty strings), null first and last word and
score 0; repeated rows are scanned each by itself; detections with equal intervals are settled by priority, then rule
number; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, let, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Families of licenses: label, keyword that any match and the blank after it have, pattern of the name, versions (none: unversioned).
FAMILIES = (
    ("agpl", " affero ", "(?: gnu)? affero general public", ("1 0", "3", "3 0")),
    ("agpl", " agpl", " agpl", ("1 0", "3", "3 0")),
    ("apache", " apache", " apache(?: software)?", ("1 0", "1 1", "2", "2 0")),
    ("artistic", " artistic", "(?: perl)? artistic", ("1 0", "2 0")),
    ("bsd-2-clause", " bsd ", " (?:2|two) clause(?: simplified)? bsd| bsd 2 clause| simplified bsd", ()),
    ("bsd-2-clause", " freebsd ", " freebsd", ()),
    ("bsd-3-clause", " bsd ", " (?:3|three) clause(?: new| modified)? bsd| bsd 3 clause| new bsd| modified bsd", ()),
    ("bsd-4-clause", " bsd ", " (?:4|four) clause(?: original)? bsd| bsd 4 clause| original bsd", ()),
    ("bsd", " bsd ", " bsd", ()),
    ("bsl", " boost", " boost(?: software)?", ("1 0",)),
    ("busl", " business source", " business source", ("1 0", "1 1")),
    ("cc-by-nc-nd", " cc ", " cc by nc nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", " cc ", " cc by nc sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", " cc ", " cc by nc", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", " cc ", " cc by nd", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", " cc ", " cc by sa", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", " cc ", " cc by", ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", " cc0", " cc0", ("1 0",)),
    ("cc-by-nc-nd", " creative commons ", " creative commons attribution non ?commercial no ?deriv(?:ative)?s?", ("3 0", "4 0")),
    ("cc-by-nc-sa", " creative commons ", " creative commons attribution non ?commercial share ?alike", ("3 0", "4 0")),
    ("cc-by-nc", " creative commons ", " creative commons attribution non ?commercial", ("3 0", "4 0")),
    ("cc-by-nd", " creative commons ", " creative commons attribution no ?deriv(?:ative)?s?", ("3 0", "4 0")),
    ("cc-by-sa", " creative commons ", " creative commons attribution share ?alike", ("2 0", "2 5", "3 0", "4 0")),
    ("cc-by", " creative commons ", " creative commons attribution", ("2 0", "2 5", "3 0", "4 0")),
    ("cc0", " creative commons ", " creative commons zero", ("1 0",)),
    ("cddl", " common development ", " common development and distribution", ("1 0", "1 1")),
    ("epl", " eclipse ", " eclipse public", ("1 0", "2 0")),
    ("eupl", " european union ", " european union public", ("1 1", "1 2")),
    ("gfdl", " free documentation", "(?: gnu)? free documentation", ("1 1", "1 2", "1 3")),
    ("gpl", " general public", "(?: gnu)? general public", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("gpl", " gpl", " gpl", ("1", "1 0", "2", "2 0", "3", "3 0")),
    ("isc", " isc ", " isc", ()),
    ("lgpl", " lesser general ", "(?: gnu)? lesser general public", ("2", "2 1", "3", "3 0")),
    ("lgpl", " library general ", "(?: gnu)? library general public", ("2", "2 0")),
    ("lgpl", " lgpl", " lgpl", ("2", "2 1", "3", "3 0")),
    ("mit", " mit ", " mit", ()),
    ("mpl", " mozilla ", " mozilla public", ("1 0", "1 1", "2", "2 0")),
    ("ms-pl", " microsoft public ", " microsoft public", ()),
    ("odbl", " open database", "(?: odc)? open database", ("1 0",)),
    ("ofl", " open font", "(?: sil)? open font", ("1 0", "1 1")),
    ("postgresql", " postgresql ", " postgresql", ()),
    ("python", " python", " python(?: software foundation)?", ("2", "2 0")),
    ("unlicense", " unlicense ", " unlicense", ()),
    ("wtfpl", " wtfpl", " wtfpl", ("1 0", "2 0")),
    ("zlib", " zlib ", " zlib(?: libpng)?", ()),
)
#: Rules of their own: label, two keywords that any match and the blank after it have, pattern, priority.
SIGNATURES = (
    ("public-domain", " public domain ", "", " (?:released|dedicated|placed|is)(?: in| into| to) the public domain", 1),
    ("public-domain", " public domain ", "", " public domain", 3),
    ("public-domain", " public domain ", " copyright ", " (?:no|not subject to) copyright (?:protection )?(?:and is )?in the public domain", 1),
    ("public-domain", " public domain ", " waive", " waives? all (?:copyright|rights) (?:and|to|in) (?:[a-z]+ ){0,6}public domain", 1),
    ("public-domain", " dedicate ", " public ", " dedicate any and all copyright interest in the software to the public domain", 1),
    ("unlicense", " unencumbered ", " public domain ", " free and unencumbered software released into the public domain", 1),
    ("unlicense", " unlicense ", " org ", " unlicense org", 2),
    ("all-rights-reserved", " all rights reserved ", "", " all rights reserved", 3),
    ("all-rights-reserved", " no part ", " reproduced ", " no part of this (?:[a-z]+ ){1,4}may be reproduced", 2),
    ("all-rights-reserved", " unauthorized ", "", " unauthorized (?:copying|reproduction|distribution|use) (?:[a-z]+ ){0,6}(?:is )?(?:strictly )?prohibited", 2),
    ("all-rights-reserved", " reproduction ", " prohibited ", " reproduction in whole or in part without (?:written )?permission is prohibited", 2),
    ("copyright", " copyright ", "", " copyright(?: c)?(?: [0-9]{4})+", 3),
    ("copyright", " copyrighted ", "", " copyrighted (?:material|work|content)", 3),
    ("copyright", " holder", " copyright ", " copyright holders?", 3),
    ("mit", " permission is hereby granted ", "", " permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("mit", " deal in the software ", "", " to deal in the software without restriction", 1),
    ("mit", " sublicense ", " copies ", " use copy modify merge publish distribute sublicense and or sell copies of the software", 1),
    ("mit", " substantial portions ", "", " shall be included in all copies or substantial portions of the software", 1),
    ("mit", " without warranty ", " as is ", " the software is provided as is without warranty of any kind express or implied", 2),
    ("mit", " expat ", " licen", " expat licen[cs]e", 2),
    ("mit", " x11 ", " licen", " x11 licen[cs]e", 2),
    ("mit", " mit ", " style ", " mit style(?: licen[cs]e)?", 3),
    ("mit", " opensource ", " mit ", " opensource org licenses mit", 1),
    ("mit-0", " mit ", " no attribution ", " mit no attribution", 1),
    ("mit-0", " mit 0 ", "", " mit 0", 2),
    ("bsd", " redistribution and use ", "", " redistribution and use in source and binary forms", 1),
    ("bsd", " redistributions ", " source code ", " redistributions of source code must retain the above copyright notice", 1),
    ("bsd", " redistributions ", " binary form ", " redistributions in binary form must reproduce the above copyright notice", 1),
    ("bsd", " disclaimed ", " warranties ", " any express or implied warranties (?:[a-z]+ ){0,20}are disclaimed", 2),
    ("bsd", " contributors ", " as is ", " provided by the (?:copyright holders|regents|author) and contributors as is", 2),
    ("bsd", " regents ", " university ", " (?:the )?regents of the university of california", 2),
    ("bsd-3-clause", " endorse ", " promote ", " used to endorse or promote products derived from this software", 1),
    ("bsd-3-clause", " opensource ", " bsd ", " opensource org licenses bsd 3 clause", 1),
    ("bsd-2-clause", " opensource ", " bsd ", " opensource org licenses bsd 2 clause", 1),
    ("bsd-4-clause", " advertising ", " mentioning ", " all advertising materials mentioning features or use of this software", 1),
    ("0bsd", " 0bsd ", "", " 0bsd", 2),
    ("0bsd", " zero clause ", " bsd ", " zero clause bsd", 2),
    ("isc", " permission to use ", "", " permission to use copy modify and or distribute this software", 1),
    ("isc", " permission to use ", " and distribute ", " permission to use copy modify and distribute this software for any purpose", 1),
    ("isc", " internet systems ", " consortium ", " internet systems consortium", 3),
    ("zlib", " altered source ", "", " altered source versions must be plainly marked as such", 1),
    ("zlib", " origin of this software ", "", " the origin of this software must not be misrepresented", 1),
    ("zlib", " held liable ", " authors ", " in no event will the authors be held liable for any damages", 2),
    ("apache", " apache ", " org ", " apache org licenses", 2),
    ("apache-2.0", " apache ", " org ", " apache org licenses license 2 0", 1),
    ("apache-2.0", " apache ", " asl ", " apache asl 2 0", 2),
    ("apache-2.0", " asl 2 0 ", "", " asl 2 0", 2),
    ("apache", " foundation ", " apache ", " licensed to the apache software foundation", 1),
    ("apache-2.0", " compliance ", " except ", " you may not use this file except in compliance with the license", 2),
    ("apache-2.0", " governing permissions ", "", " specific language governing permissions and limitations under the license", 1),
    ("apache-2.0", " as is basis ", "", " distributed on an as is basis without warranties or conditions of any kind", 1),
    ("gpl", " gnu ", " org ", " gnu org licenses(?: gpl)?", 2),
    ("gpl", " gnu ", " gpl ", " gnu gpl", 2),
    ("gpl", " free software foundation ", "", " free software foundation", 3),
    ("gpl", " redistribute it ", " general public ", " you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1),
    ("gpl", " fitness for a particular purpose ", " gnu ", " fitness for a particular purpose see the gnu general public licen[cs]e", 1),
    ("gpl", " received a copy ", " general public ", " received a copy of the gnu general public licen[cs]e", 1),
    ("gpl", " copyleft ", "", " copyleft", 3),
    ("gpl", " classpath ", " exception ", " classpath exception", 2),
    ("gpl", " gcc ", " exception ", " gcc runtime library exception", 2),
    ("gpl-2.0", " gplv2 ", "", " gplv2", 2),
    ("gpl-3.0", " gplv3 ", "", " gplv3", 2),
    ("gpl-2.0", " linux kernel ", " licen", " linux kernel (?:is )?licen[cs]ed?", 3),
    ("lgpl", " received a copy ", " lesser general ", " received a copy of the gnu lesser general public licen[cs]e", 1),
    ("lgpl", " redistribute it ", " lesser general ", " you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", 1),
    ("lgpl", " gnu ", " org ", " gnu org licenses lgpl", 1),
    ("lgpl-2.1", " lgplv2 ", "", " lgplv2(?: 1)?", 2),
    ("lgpl-3.0", " lgplv3 ", "", " lgplv3", 2),
    ("agpl", " received a copy ", " affero ", " received a copy of the gnu affero general public licen[cs]e", 1),
    ("agpl", " gnu ", " org ", " gnu org licenses agpl", 1),
    ("agpl-3.0", " agplv3 ", "", " agplv3", 2),
    ("agpl", " remotely ", " network ", " interacting with it remotely through a computer network", 1),
    ("gfdl", " invariant sections ", "", " with no invariant sections", 1),
    ("gfdl", " cover texts ", "", " no front cover texts(?: and no back cover texts)?", 1),
    ("gfdl", " gfdl ", "", " gfdl", 2),
    ("mpl-2.0", " mozilla ", " org ", " mozilla org mpl 2 0", 1),
    ("mpl", " mozilla ", " org ", " mozilla org mpl", 2),
    ("mpl-2.0", " source code form ", " mozilla ", " this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", 1),
    ("mpl-1.1", " initial developer ", " original code ", " the initial developer of the original code is", 1),
    ("mpl", " secondary licenses ", "", " incompatible with secondary licenses", 1),
    ("epl", " eclipse ", " org ", " eclipse org legal epl", 1),
    ("epl", " accompanying materials ", " program ", " this program and the accompanying materials are made available under", 2),
    ("cddl", " cddl ", "", " cddl(?: 1 [01])?", 2),
    ("cddl", " glassfish ", " licen", " glassfish org public cddl gpl(?: html)? licen[cs]e", 2),
    ("cpl", " common public ", " licen", " common public licen[cs]e(?: version)?(?: 1 0)?", 2),
    ("ipl", " ibm public ", " licen", " ibm public licen[cs]e(?: version)?(?: 1 0)?", 2),
    ("bsl", " boost ", " org ", " boost org license 1 0", 1),
    ("bsl", " machine executable ", "", " machine executable object code generated by a source language processor", 1),
    ("busl", " change date ", " licen", " change date (?:[a-z0-9]+ ){0,8}change licen[cs]e", 2),
    ("busl", " additional use grant ", "", " additional use grant", 2),
    ("sspl", " server side public ", "", " server side public licen[cs]e", 2),
    ("sspl", " sspl ", "", " sspl", 2),
    ("elastic", " elastic ", " licen", " elastic licen[cs]e(?: 2 0)?", 2),
    ("confluent", " confluent ", " licen", " confluent community licen[cs]e", 2),
    ("commons-clause", " commons clause ", "", " commons clause", 2),
    ("polyform", " polyform ", "", " polyform (?:noncommercial|shield|strict|small business|free trial|internal use|perimeter)", 2),
    ("parity", " parity ", " licen", " parity public licen[cs]e", 2),
    ("hippocratic", " hippocratic ", " licen", " hippocratic licen[cs]e", 2),
    ("anti-996", " anti 996 ", "", " anti 996 licen[cs]e", 2),
    ("osl", " open software ", " licen", " open software licen[cs]e(?: v| version)?(?: 3 0| 2 1)?", 2),
    ("afl", " academic free ", " licen", " academic free licen[cs]e(?: v| version)?(?: 3 0| 2 1)?", 2),
    ("ecl", " educational community ", " licen", " educational community licen[cs]e", 2),
    ("ncsa", " ncsa ", " licen", " (?:university of illinois )?ncsa open source licen[cs]e", 2),
    ("upl", " universal permissive ", " licen", " universal permissive licen[cs]e", 2),
    ("cecill", " cecill ", "", " cecill(?: [bc])?", 2),
    ("eupl", " eupl ", "", " eupl(?: v)?(?: 1 [12])?", 2),
    ("mulan", " mulan ", "", " mulan (?:psl|permissive software licen[cs]e)(?: v2)?", 2),
    ("openssl", " openssl ", " licen", " openssl licen[cs]e", 2),
    ("openssl", " openssl toolkit ", "", " for use in the openssl toolkit", 1),
    ("ssleay", " eric young ", "", " written by eric young", 2),
    ("curl", " curl ", " licen", " curl licen[cs]e", 2),
    ("ruby", " ruby ", " licen", " (?:the )?ruby licen[cs]e", 2),
    ("php", " php ", " licen", " php licen[cs]e(?: version)?(?: 3 0[01]?)?", 2),
    ("perl", " same terms as perl ", "", " under the same terms as perl itself", 1),
    ("tcl", " tcl ", " licen", " tcl tk licen[cs]e", 2),
    ("vim", " vim ", " licen", " vim licen[cs]e", 2),
    ("imagemagick", " imagemagick ", " licen", " imagemagick licen[cs]e", 2),
    ("libpng", " libpng ", " licen", " libpng licen[cs]e(?: version)?(?: 2)?", 2),
    ("libtiff", " libtiff ", " licen", " libtiff licen[cs]e", 2),
    ("ijg", " independent jpeg group ", "", " based in part on the work of the independent jpeg group", 1),
    ("unicode", " unicode ", " licen", " unicode (?:inc )?licen[cs]e agreement", 2),
    ("w3c", " w3c ", " software ", " w3c software (?:notice and licen[cs]e|and document licen[cs]e)", 2),
    ("w3c", " w3c ", " document ", " w3c document licen[cs]e", 2),
    ("ms-rl", " microsoft reciprocal ", "", " microsoft reciprocal licen[cs]e", 2),
    ("ms-limited", " microsoft limited ", "", " microsoft limited public licen[cs]e", 2),
    ("beerware", " beer ware ", "", " beer ware licen[cs]e", 2),
    ("beerware", " buy me a beer ", "", " you can buy me a beer in return", 1),
    ("wtfpl", " what the ", " want to ", " do what the [a-z]+ you want to(?: public licen[cs]e)?", 1),
    ("json", " good not evil ", "", " shall be used for good not evil", 1),
    ("artistic", " artistic ", " clarified ", " clarified artistic licen[cs]e", 2),
    ("lppl", " latex project ", "", " latex project public licen[cs]e", 2),
    ("lppl", " lppl ", "", " lppl(?: 1 3c?)?", 2),
    ("ofl", " reserved font name", "", " with reserved font names?", 1),
    ("ofl", " scripts sil ", "", " scripts sil org ofl", 1),
    ("ofl", " ofl ", " licen", " ofl licen[cs]e", 2),
    ("ubuntu-font", " ubuntu font ", "", " ubuntu font licen[cs]e", 2),
    ("bitstream-vera", " bitstream vera ", "", " bitstream vera", 3),
    ("cc", " creativecommons ", " org ", " creativecommons org licenses", 2),
    ("cc-by", " creativecommons ", " org ", " creativecommons org licenses by [1-4] [05]", 1),
    ("cc-by-sa", " creativecommons ", " org ", " creativecommons org licenses by sa [1-4] [05]", 1),
    ("cc-by-nd", " creativecommons ", " org ", " creativecommons org licenses by nd [1-4] [05]", 1),
    ("cc-by-nc", " creativecommons ", " org ", " creativecommons org licenses by nc [1-4] [05]", 1),
    ("cc-by-nc-sa", " creativecommons ", " org ", " creativecommons org licenses by nc sa [1-4] [05]", 1),
    ("cc-by-nc-nd", " creativecommons ", " org ", " creativecommons org licenses by nc nd [1-4] [05]", 1),
    ("cc0", " creativecommons ", " org ", " creativecommons org publicdomain zero", 1),
    ("cc", " creative commons ", " licen", " (?:a|the) creative commons licen[cs]e", 3),
    ("cc", " some rights reserved ", "", " some rights reserved", 3),
    ("cc-by-nc", " non commercial ", " only ", " for non commercial (?:use|purposes) only", 3),
    ("cc-by-nc", " noncommercial ", " only ", " for noncommercial (?:use|purposes) only", 3),
    ("odbl", " odbl ", "", " odbl(?: 1 0)?", 2),
    ("odbl", " openstreetmap ", " contributors ", " openstreetmap contributors", 2),
    ("odc-by", " open data commons ", "", " open data commons attribution licen[cs]e", 2),
    ("pddl", " open data commons ", " public domain ", " open data commons public domain dedication(?: and licen[cs]e)?", 1),
    ("ogl", " open government ", " licen", " open government licen[cs]e", 2),
    ("cdla", " community data ", " licen", " community data licen[cs]e agreement (?:permissive|sharing)", 2),
    ("openrail", " openrail ", "", " openrail(?: m)?", 2),
    ("llama", " llama ", " community ", " llama (?:[234] )?community licen[cs]e", 2),
    ("responsible-ai", " responsible ai ", " licen", " responsible ai licen[cs]e", 2),
    ("proprietary", " proprietary ", "", " proprietary(?: and confidential| license| software)", 2),
    ("proprietary", " confidential ", " property ", " confidential (?:and proprietary )?(?:information and )?property of", 2),
    ("proprietary", " trade secret", "", " contains? (?:confidential )?trade secrets?", 2),
    ("proprietary", " reverse engineer ", "", " (?:reverse engineer|not reverse engineer) (?:decompile or disassemble|decompile disassemble)", 2),
    ("proprietary", " end user ", " licen", " end user licen[cs]e agreement", 2),
    ("proprietary", " eula ", "", " eula", 3),
    ("proprietary", " evaluation ", " only ", " for evaluation (?:use|purposes) only", 3),
    ("proprietary", " internal use only ", "", " for internal use only", 3),
    ("trademark", " trademark", " registered ", " (?:is a|are) registered trademarks?(?: of)?", 3),
    ("patent", " patent ", " royalty free ", " royalty free irrevocable (?:[a-z]+ ){0,6}patent licen[cs]e", 2),
    ("dual", " dual licensed ", "", " dual licensed(?: under)?", 2),
    ("dual", " triple licensed ", "", " triple licensed(?: under)?", 2),
    ("noassertion", " spdx ", " noassertion ", " spdx license identifier noassertion", 1),
    ("licenseref", " spdx ", " licenseref ", " spdx license identifier licenseref [a-z0-9]+", 1),
    ("see-license", " see ", " licen", " see (?:the )?licen[cs]e (?:file )?(?:in|for) (?:the )?(?:details|root|terms|more)", 3),
    ("see-license", " accompanying ", " licen", " see (?:the )?accompanying licen[cs]e", 3),
)
SCORES = (1.0, 0.8, 0.5)


def rules() -> list[dict]:
    """The ordered rules: for each family and version a tag, a grant, a name with version and a bare name; then the signatures."""
    out: list[dict] = []

    def add(label: str, keyword: str, also: str, pattern: str, priority: int) -> None:
        rule = {"label": label, "keyword": keyword, "also": also, "pattern": f"(?:{pattern})(?= )", "priority": priority}
        if rule not in out:
            out.append(rule)

    for label, keyword, name, versions in FAMILIES:
        grant = f" (?:licensed|released|distributed|available)(?: under)(?: the)?(?: terms of)?(?: the)?(?:{name})(?: public)?(?: licen[cs]e)?"
        for v in versions:
            # a longer version of the list that starts with this one must not be cut short
            longer = "".join(f"(?! {x[len(v):].strip()} )" for x in versions if x.startswith(v + " "))
            said = f"(?: version| ver| v)? ?v?{v}{longer}(?: or(?: any)? later(?: version)?)?(?: only)?(?: international| unported)?"
            tag = f"{label}-{v.replace(' ', '.')}"
            words = tag.replace("-", " ").replace(".", " ")
            add(tag, " spdx ", " identifier ", f" spdx license identifier {words}(?: or later| only)?", 1)
            add(tag, keyword, " under ", grant + said, 1)
            add(tag, keyword, "", f"(?:{name})(?: licen[cs]e)?{said}", 2)
        if not versions:
            add(label, " spdx ", " identifier ", f" spdx license identifier {label.replace('-', ' ')}", 1)
        add(label, keyword, " under ", grant, 1 if not versions else 2)
        add(label, keyword, " licen", f"(?:{name})(?: licen[cs]e)", 3)
    for label, keyword, also, pattern, priority in SIGNATURES:
        add(label, keyword, also, pattern, priority)
    return [{"id": i} | r for i, r in enumerate(out)]


def keywords() -> list[str]:
    """Every keyword of the rules."""
    return sorted({k for r in rules() for k in (r["keyword"], r["also"]) if k})


def gate() -> str:
    """One pattern that finds any rule's first keyword or a base phrase: a text without it has nothing to detect. Alternatives are dealt by their first letter."""
    every = sorted({r["keyword"] for r in rules()} | {f" {p} " for p, _ in BASE})
    short = [k for k in every if not any(x != k and x in k for x in every)]
    by: dict[str, list[str]] = {}
    for k in short:
        if k[0] != " ":
            raise ValueError(f"the keyword {k!r} must begin a word")
        by.setdefault(k[1], []).append(k[2:])
    return " (?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items())) + ")"


def normalised(text: Column) -> Column:
    """' word word ... word ', or a single blank without words."""
    bare = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(bare == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _places(norm: Column, pattern: Column) -> Column:
    """start and end words (end excluded) of the matches, in order."""

    def both(found: Column) -> Column:
        gaps = F.transform(F.split(norm, pattern, -1), lambda x: _blanks(x))
        lengths = F.transform(found, lambda x: _blanks(x))

        def fold(g: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
            step = lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["n"]).alias("e")))).alias("out"))
            return F.aggregate(F.arrays_zip(F.slice(g, 1, F.size(g) - 1).alias("g"), lengths.alias("n")), start, step)["out"]

        return F.when(F.size(found) == 0, F.array().cast("array<struct<s:int,e:int>>")).otherwise(let(gaps, fold))

    return let(F.regexp_extract_all(norm, pattern, F.lit(0)), both)


def scan(text: Column) -> Column:
    """A struct for a text: n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    table_json, shape = json.dumps(rules()), "array<struct<id:int,label:string,keyword:string,also:string,pattern:string,priority:int>>"
    known = F.from_json(F.lit(table_json), shape)
    bases = F.from_json(F.lit(json.dumps([{"label": x, "pattern": f" {p}(?= )"} for p, x in BASE])), "array<struct<label:string,pattern:string>>")

    def scanned(norm: Column) -> Column:
        n = (_blanks(norm) - 1).cast("long")
        may = norm.rlike(gate())
        none = F.struct(n.alias("n_words"), F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_detections"))
        base = F.flatten(F.transform(bases, lambda b: F.transform(_places(norm, b["pattern"]), lambda p: F.struct(p["s"].alias("s"), b["label"].alias("label")))))
        there = F.filter(F.array(F.lit(""), *[F.lit(k) for k in keywords()]), lambda k: F.contains(norm, k))
        fit = let(there, lambda t: F.filter(known, lambda r: F.array_contains(t, r["keyword"]) & F.array_contains(t, r["also"])))
        found = F.flatten(F.transform(fit, lambda r: F.transform(_places(norm, r["pattern"]), lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("e"), r["priority"].alias("p"), r["id"].alias("id"), r["label"].alias("label")))))
        return F.when(~may, none).otherwise(let(F.struct(base.alias("base"), F.sort_array(found).alias("found")), lambda d: result(n, d)))

    def result(n: Column, d: Column) -> Column:
        start = F.struct(F.lit(-1).alias("m1"), F.lit(-1).alias("m2"), F.lit(-1).alias("m3"), F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"), F.lit(0).cast("long").alias("n"))

        def step(a: Column, x: Column) -> Column:
            end = -x["e"]
            # starts come in order, so what reaches at least as far holds this interval
            inside = F.when(x["p"] == 1, a["m1"]).when(x["p"] == 2, F.greatest(a["m1"], a["m2"])).otherwise(F.greatest(a["m1"], a["m2"], a["m3"])) >= end
            taken = F.struct(
                *[F.when(x["p"] == k, F.greatest(a[f"m{k}"], end)).otherwise(a[f"m{k}"]).alias(f"m{k}") for k in (1, 2, 3)],
                F.when(F.array_contains(a["labels"], x["label"]), a["labels"]).otherwise(F.array_append(a["labels"], x["label"])).alias("labels"),
                F.least(a["best"], x["p"]).alias("best"),
                (a["n"] + 1).alias("n"),
            )
            return F.when(inside, a).otherwise(taken)

        def done(kept: Column) -> Column:
            base_labels = F.array_sort(F.array_distinct(F.transform(d["base"], lambda x: x["label"])))
            places = F.transform(d["base"], lambda x: x["s"].cast("long"))
            best = F.when(kept["best"] == 1, SCORES[0]).when(kept["best"] == 2, SCORES[1]).when((kept["best"] == 3) | (F.size(d["base"]) > 0), SCORES[2]).otherwise(0.0)
            return F.struct(
                n.alias("n_words"),
                F.size(d["base"]).cast("long").alias("n_base"),
                F.array_min(places).alias("first_word"),
                F.array_max(places).alias("last_word"),
                F.array_join(base_labels, ",").alias("base_labels"),
                F.array_join(F.array_sort(F.array_union(base_labels, kept["labels"])), ",").alias("labels"),
                best.alias("score"),
                kept["n"].alias("n_detections"),
            )

        return let(F.aggregate(d["found"], start, step), done)

    return let(normalised(text), scanned)


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    q = docs.select("doc_id", scan(F.col("text")).alias("q"))
    return q.select("doc_id", *[F.col(f"q.{k}").alias(k) for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")])
