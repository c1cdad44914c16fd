"""Signature rules for license notices, written over a text's lower-case words, each after one space.

A rule is (priority, label, keyword, pattern): the keyword stands in every match of the pattern, so a text without it
needs no search. Lower priorities win. Patterns have no unbounded repeats.
"""

from __future__ import annotations

#: Phrases that always count, and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Label; keyword; how notices name the license; its identifier in words.
NAMES = """
mit; mit licen; (?:the )?mit licen[cs]e; mit
mit-0; mit no attribution; mit no attribution(?: licen[cs]e)?; mit 0
x11; x11 licen; x11 licen[cs]e; x11
apache-1.1; apache; apache (?:software )?licen[cs]e (?:version )?1 1; apache 1 1
apache-2; apache; apache (?:software )?licen[cs]e(?: version| v)? 2(?: 0)?; apache 2 0
apache-2; apache 2; apache 2(?: 0)?(?: licen[cs]e)?; apache 2
apache; apache; apache (?:software )?licen[cs]e; apache
gpl-1; general public licen; (?:gnu )?general public licen[cs]e(?: version| v)? 1(?: 0)?; gpl 1 0(?: only| or later)?
gpl-2; general public licen; (?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)?; gpl 2 0(?: only| or later)?
gpl-3; general public licen; (?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)?; gpl 3 0(?: only| or later)?
gpl; general public licen; (?:gnu )?general public licen[cs]e; gpl
gpl-2; gpl; (?:gnu )?gpl ?(?:version |v)?2(?: 0)?; gplv2
gpl-3; gpl; (?:gnu )?gpl ?(?:version |v)?3(?: 0)?; gplv3
lgpl-2; lgpl; (?:gnu )?lgpl ?(?:version |v)?2(?: 0)?; lgpl 2 0(?: only| or later)?
lgpl-2.1; lgpl; (?:gnu )?lgpl ?(?:version |v)?2 1; lgpl 2 1(?: only| or later)?
lgpl-3; lgpl; (?:gnu )?lgpl ?(?:version |v)?3(?: 0)?; lgpl 3 0(?: only| or later)?
lgpl-2.1; lesser general public; (?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1; lgpl 2 1
lgpl-3; lesser general public; (?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)?; lgpl 3 0
lgpl; lesser general public; (?:gnu )?lesser general public licen[cs]e; lgpl
lgpl-2; library general public; (?:gnu )?library general public licen[cs]e; lgpl 2
agpl-3; affero; (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?; agpl 3 0(?: only| or later)?
agpl; affero; (?:gnu )?affero general public licen[cs]e; agpl
agpl-3; agpl; (?:gnu )?agpl ?(?:version |v)?3(?: 0)?; agplv3
fdl-1.3; free documentation; (?:gnu )?free documentation licen[cs]e(?: version)? 1 3; gfdl 1 3(?: only| or later)?
fdl; free documentation; (?:gnu )?free documentation licen[cs]e; gfdl
bsd-0; zero clause bsd; zero clause bsd(?: licen[cs]e)?; 0bsd
bsd-2; bsd; (?:2|two) clause (?:simplified )?bsd(?: licen[cs]e)?; bsd 2 clause
bsd-2; bsd 2; bsd 2 clause(?: licen[cs]e)?; bsd 2 clause simplified
bsd-2; simplified bsd; simplified bsd licen[cs]e; bsd simplified
bsd-3; bsd; (?:3|three) clause (?:new |revised |modified )?bsd(?: licen[cs]e)?; bsd 3 clause
bsd-3; bsd 3; bsd 3 clause(?: licen[cs]e)?; bsd 3 clause new
bsd-3; bsd; (?:new|revised|modified) bsd licen[cs]e; bsd new
bsd-4; bsd; (?:4|four) clause bsd(?: licen[cs]e)?; bsd 4 clause
bsd; bsd licen; bsd licen[cs]e; bsd
isc; isc licen; isc licen[cs]e; isc
mpl-1.1; mozilla public; mozilla public licen[cs]e(?: version| v)? 1 1; mpl 1 1
mpl-2; mozilla public; mozilla public licen[cs]e(?: version| v)? 2(?: 0)?; mpl 2 0
mpl; mozilla public; mozilla public licen[cs]e; mpl
epl-1; eclipse public; eclipse public licen[cs]e(?: version| v)? 1(?: 0)?; epl 1 0
epl-2; eclipse public; eclipse public licen[cs]e(?: version| v)? 2(?: 0)?; epl 2 0
epl; eclipse public; eclipse public licen[cs]e; epl
edl-1; eclipse distribution; eclipse distribution licen[cs]e(?: version| v)? 1(?: 0)?; edl 1 0
cddl-1; common development; common development and distribution licen[cs]e(?: version)?(?: 1(?: [01])?)?; cddl 1 [01]
cpl-1; common public licen; common public licen[cs]e(?: version)?(?: 1(?: 0)?)?; cpl 1 0
eupl; european union public; european union public licen[cs]e(?: version)?(?: 1 [012])?; eupl 1 [012]
osl-3; open software licen; open software licen[cs]e(?: version)?(?: 3(?: 0)?)?; osl 3 0
afl-3; academic free licen; academic free licen[cs]e(?: version)?(?: [123](?: [012])?)?; afl 3 0
artistic-1; artistic licen; artistic licen[cs]e(?: version)? 1(?: 0)?; artistic 1 0
artistic-2; artistic licen; artistic licen[cs]e(?: version)? 2(?: 0)?; artistic 2 0
artistic; artistic licen; artistic licen[cs]e; artistic
zlib; zlib; zlib(?: libpng)? licen[cs]e; zlib
libpng; libpng licen; libpng licen[cs]e; libpng 2 0
boost-1; boost software licen; boost software licen[cs]e(?: version)?(?: 1(?: 0)?)?; bsl 1 0
bsl-1.1; business source licen; business source licen[cs]e(?: version)?(?: 1 1)?; busl 1 1
sspl-1; server side public; server side public licen[cs]e(?: version)?(?: 1)?; sspl 1 0
elastic-2; elastic licen; elastic licen[cs]e(?: version)?(?: 2(?: 0)?)?; elastic 2 0
psf; python software foundation licen; python software foundation licen[cs]e(?: version)?(?: 2)?; psf 2 0
php-3; php licen; php licen[cs]e(?: version)?(?: 3 0[01])?; php 3 0[01]?
ruby; ruby licen; ruby licen[cs]e; ruby
w3c; w3c software; w3c software(?: notice and)?(?: and document)? licen[cs]e; w3c
unicode; unicode licen; unicode licen[cs]e(?: agreement)?; unicode dfs 2016
ncsa; university of illinois; university of illinois ncsa open source licen[cs]e; ncsa
ms-pl; microsoft public; microsoft public licen[cs]e; ms pl
ms-rl; microsoft reciprocal; microsoft reciprocal licen[cs]e; ms rl
ofl-1.1; open font licen; (?:sil )?open font licen[cs]e(?: version)?(?: 1 [01])?; ofl 1 [01]
wtfpl; wtfpl; wtfpl(?: licen[cs]e)?; wtfpl
unlicense; unlicen; (?:the )?unlicense; unlicense
odbl-1; database licen; open (?:data commons )?database licen[cs]e(?: version)?(?: 1(?: 0)?)?; odbl 1 0
odc-by-1; open data commons; open data commons attribution licen[cs]e; odc by 1 0
pddl-1; public domain dedication; public domain dedication and licen[cs]e; pddl 1 0
ogl-3; open government licen; open government licen[cs]e(?: version| v)?(?: ?[123](?: 0)?)?; ogl uk 3 0
cdla; community data licen; community data licen[cs]e agreement(?: permissive| sharing)?; cdla (?:permissive|sharing) [12] 0
openrail; openrail; (?:creativeml )?(?:big ?science )?openrail(?: [mds]{1,2})?(?: licen[cs]e)?; openrail
llama; llama; llama (?:2 |3 |3 1 )?community licen[cs]e(?: agreement)?; llama
cc0-1; cc0; (?:creative commons )?cc0(?: 1 0)?(?: universal)?; cc0 1 0
cc0-1; creative commons zero; creative commons zero(?: v?1 0)?(?: universal)?; cc0
cc-by-nc-nd; by nc nd; (?:cc|creative commons) by nc nd(?: [1234] [05])?; cc by nc nd [1234] [05]
cc-by-nc-sa; by nc sa; (?:cc|creative commons) by nc sa(?: [1234] [05])?; cc by nc sa [1234] [05]
cc-by-nc; by nc; (?:cc|creative commons) by nc(?: [1234] [05])?; cc by nc [1234] [05]
cc-by-nd; by nd; (?:cc|creative commons) by nd(?: [1234] [05])?; cc by nd [1234] [05]
cc-by-sa; by sa; (?:cc|creative commons) by sa(?: [1234] [05])?; cc by sa [1234] [05]
cc-by; cc by; cc by(?: [1234] [05])?; cc by [1234] [05]
cc-by-nc-nd; creative commons attribution; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?; by nc nd
cc-by-nc-sa; creative commons attribution; creative commons attribution non ?commercial share ?alike(?: [1234] [05])?; by nc sa
cc-by-nc; creative commons attribution; creative commons attribution non ?commercial(?: [1234] [05])?; by nc
cc-by-nd; creative commons attribution; creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?; by nd
cc-by-sa; creative commons attribution; creative commons attribution share ?alike(?: [1234] [05])?; by sa
cc-by; creative commons attribution; creative commons attribution(?: [1234] [05])?; by
creative-commons; creative commons; creative commons(?: licen[cs]e)?; cc
"""

#: Priority; label; keyword; pattern, of notices that do not give a license's name as above.
NOTICES = """
1; mit; permission is hereby granted free of charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1; isc; permission to use copy modify and; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
1; bsd; redistribution and use in source and binary forms; redistribution and use in source and binary forms with or without modification are permitted
1; bsd-3; neither the name; neither the name of .{1,80}? nor the names of its contributors may be used
1; bsd-4; all advertising materials; all advertising materials mentioning features or use of this software
1; zlib; altered source versions; altered source versions must be plainly marked as such
1; boost-1; permission is hereby granted free of charge; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
1; unlicense; free and unencumbered; this is free and unencumbered software released into the public domain
1; gpl; free software you can redistribute; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
1; lgpl; free software you can redistribute; this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
1; gpl-2; either version 2; either version 2 of the license or at your option any later version
1; gpl-3; either version 3; either version 3 of the license or at your option any later version
1; lgpl-2.1; either version 2 1; either version 2 1 of the license or at your option any later version
1; apache-2; apache org licenses; apache org licenses license 2 0(?: (?:html|txt))?
1; mpl-2; mozilla org mpl; mozilla org mpl 2 0
1; mpl-2; subject to the terms of the mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
1; gpl; gnu org licenses; gnu org licenses(?: old licenses)? gpl(?: [123] 0)?(?: (?:html|txt))?
1; lgpl; gnu org licenses; gnu org licenses(?: old licenses)? lgpl(?: [23] [01])?(?: (?:html|txt))?
1; agpl; gnu org licenses; gnu org licenses agpl(?: 3 0)?(?: (?:html|txt))?
1; fdl; gnu org licenses; gnu org licenses fdl(?: 1 [123])?(?: (?:html|txt))?
1; mit; opensource org licenses; opensource org licenses mit(?: license)?
1; bsd; opensource org licenses; opensource org licenses bsd [23] clause
1; cc0-1; creativecommons org publicdomain; creativecommons org publicdomain zero 1 0
1; cc-by; creativecommons org licenses; creativecommons org licenses by [1234] [05]
1; cc-by-sa; creativecommons org licenses; creativecommons org licenses by sa [1234] [05]
1; cc-by-nc; creativecommons org licenses; creativecommons org licenses by nc [1234] [05]
1; cc-by-nd; creativecommons org licenses; creativecommons org licenses by nd [1234] [05]
1; cc-by-nc-sa; creativecommons org licenses; creativecommons org licenses by nc sa [1234] [05]
1; cc-by-nc-nd; creativecommons org licenses; creativecommons org licenses by nc nd [1234] [05]
1; public-domain; public domain; (?:released|dedicated|placed) (?:in|into|to) the public domain
3; public-domain; public domain; (?:in the )?public domain
2; proprietary; proprietary; proprietary and confidential
2; proprietary; end user licen; end user licen[cs]e agreement
2; proprietary; may not be reproduced; may not be (?:reproduced|copied|distributed)(?: or (?:reproduced|copied|distributed|transmitted))? without (?:the )?(?:prior )?(?:written )?permission
3; all-rights-reserved; all rights reserved; all rights reserved
3; noncommercial; non commercial; (?:for )?non commercial (?:use|purposes) only
3; noncommercial; noncommercial; (?:for )?noncommercial (?:use|purposes) only
3; research-only; research; for research (?:use|purposes) only
4; license-file; license file; see (?:the )?license file(?: for (?:details|terms))?
4; license-file; copying file; see (?:the )?copying file(?: for (?:details|terms))?
4; copyright; copyright; copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})?
"""

#: How a notice grants a named license, refers to it, or only names it: priority and what leads up to the name.
WAYS = (
    (1, "(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|offered) (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"),
    (2, "(?:under|subject to|in accordance with|in compliance with|a copy of) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"),
    (3, ""),
)
LEAST = 4


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of all rules in order: the base phrases at priority 0, notices, then each name in each way and by its identifier."""
    cut = lambda table: [[x.strip() for x in line.split(";")] for line in table.strip().split("\n")]
    out = [(0, label, f" {phrase}", f" {phrase}") for label, phrase in BASE]
    out += [(int(p), label, f" {keyword}", f" {pattern}") for p, label, keyword, pattern in cut(NOTICES)]
    for label, keyword, name, identifier in cut(NAMES):
        out += [(p, label, f" {keyword}", f" {lead}{name}") for p, lead in WAYS]
        out.append((1, label, " spdx license identifier", f" spdx license identifier {identifier}"))
    return out


def any_of(words: list[str]) -> str:
    """A pattern that matches the longest of these words at a place, as a tree of their letters: where a letter fits no branch, the search goes on."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [letter + pattern(child) for letter, child in sorted(node.items()) if letter]
        body = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})" if branches else ""
        return f"(?:{body})?" if "" in node and body else body

    return pattern(tree)
