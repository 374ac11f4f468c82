"""Signatures of license bodies, notices, deeds and addresses, written by hand.

A signature is a regular expression over lower-case words with one blank between
them. Its keyword is a phrase every match holds. ``GAP`` stands for up to a number of
words that a text may have in between, as few as possible.
"""

from __future__ import annotations


def gap(most: int) -> str:
    return f"(?: [^ ]+){{0,{most}}}? "


_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of (?:this|the) software and associated documentation files"
_BSD = "redistribution and use (?:in|of) source and binary forms with or without modification are permitted"
_FEE = "permission to use copy modify and(?: or)? distribute this software"
_TERMS = "you (?:can|may) redistribute it and or modify it under the terms of"
_FSF = "as published by the free software foundation"
_LATER = " or (?:at your option )?any later version"
_FILE = "the contents of this file are subject to"

# fixed values: (label, keyword, pattern, priority, score); smaller priority is better
SIGNATURES: list[tuple[str, str, str, int, float]] = [
    # permissive bodies
    ("mit", "associated documentation files", _GRANT, 3, 0.95),
    ("mit-0", "associated documentation files",
     f"{_GRANT}{gap(45)}to permit persons to whom the software is furnished to do so the software is provided as is", 2, 0.97),
    ("ncsa", "associated documentation files", f"{_GRANT}{gap(70)}redistributions of source code must retain", 2, 0.97),
    ("x11", "used in advertising", "except as contained in this notice the names? of" + gap(12)
     + "shall not be used in advertising or otherwise to promote the sale", 2, 0.95),
    ("unicode", "unicode data files", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 2, 0.97),
    ("json", "good not evil", "the software shall be used for good not evil", 2, 0.97),
    ("bsd-2-clause", "source and binary forms", _BSD, 4, 0.9),
    ("bsd-3-clause", "source and binary forms", f"{_BSD}{gap(130)}neither the names? of", 3, 0.95),
    ("bsd-3-clause", "source and binary forms", f"{_BSD}{gap(130)}may not be used to endorse or promote products", 3, 0.95),
    ("bsd-4-clause", "advertising materials mentioning",
     f"{_BSD}{gap(110)}all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 2, 0.95),
    ("bsd-4-clause", "advertising materials mentioning",
     f"{_BSD}{gap(110)}all advertising materials mentioning{gap(60)}neither the names? of", 2, 0.97),
    ("bsd-4-clause", "advertising materials mentioning",
     f"{_BSD}{gap(110)}all advertising materials mentioning{gap(60)}may not be used to endorse or promote products", 2, 0.97),
    ("isc", "distribute this software for any purpose",
     f"{_FEE} for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 2, 0.97),
    ("bsd-0-clause", "distribute this software for any purpose",
     f"{_FEE} for any purpose with or without fee is hereby granted the software is provided as is", 2, 0.97),
    ("hpnd", "this software and its documentation", f"{_FEE} and its documentation for any purpose(?: and)?(?: with or)? without fee is hereby granted", 3, 0.9),
    ("postgresql", "without a written agreement",
     f"{_FEE} and its documentation for any purpose without fee and without a written agreement is hereby granted", 2, 0.97),
    ("zlib", "authors be held liable",
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", 2, 0.95),
    ("zlib", "origin of this software must not be misrepresented", "the origin of this software must not be misrepresented", 3, 0.9),
    ("libpng", "png reference library", "the png reference library is supplied as is", 2, 0.95),
    ("boost-1", "accompanying documentation covered by this license",
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 2, 0.97),
    ("upl-1", "subject to the condition set forth below",
     "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", 2, 0.95),
    ("beerware", "whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff", 2, 0.95),
    ("wtfpl", "changing it is allowed",
     "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 2, 0.97),
    ("wtfpl", "you just do what the", "you just do what the [a-z]+ you want to", 2, 0.95),
    ("artistic-1", "state the conditions under which a package",
     "the intent of this document is to state the conditions under which a package may be copied", 2, 0.97),
    ("artistic-2", "given free software package", "this license establishes the terms under which a given free software package may be copied", 2, 0.97),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 2, 0.95),
    ("php-3", "includes php software", "this product includes php software freely available from", 2, 0.95),
    ("python-2", "python software foundation psf",
     "this license agreement is between the python software foundation psf and the individual or organization", 2, 0.97),
    ("vim", "unmodified copies of vim", "there are no restrictions on distributing unmodified copies of vim", 2, 0.95),
    # apache
    ("apache-2", "except in compliance with the license",
     "licensed under the apache license version 2 0 the license you may not use this (?:file|work|software) except in compliance with the license", 2, 0.99),
    ("apache-2", "january 2004", "apache license version 2 0 january 2004", 2, 0.99),
    ("apache-1.1", "documentation included with the redistribution",
     "the end user documentation included with the redistribution if any must include the following acknowledge?ment", 3, 0.9),
    # notices of the copyleft family
    ("gpl-2", "redistribute it and or modify", f"{_TERMS} the gnu general public license {_FSF}(?: either)? version 2(?: of the license)?", 3, 0.95),
    ("gpl-2", "redistribute it and or modify", f"{_TERMS} the gnu general public license version 2(?: only)?(?: {_FSF})?", 3, 0.95),
    ("gpl-2-or-later", "redistribute it and or modify", f"{_TERMS} the gnu general public license {_FSF} either version 2 of the license{_LATER}", 2, 0.97),
    ("gpl-3", "redistribute it and or modify", f"{_TERMS} the gnu general public license {_FSF}(?: either)? version 3(?: of the license)?", 3, 0.95),
    ("gpl-3", "redistribute it and or modify", f"{_TERMS} the gnu general public license version 3(?: only)?(?: {_FSF})?", 3, 0.95),
    ("gpl-3-or-later", "redistribute it and or modify", f"{_TERMS} the gnu general public license {_FSF} either version 3 of the license{_LATER}", 2, 0.97),
    ("lgpl-2", "redistribute it and or modify", f"{_TERMS} the gnu library general public license {_FSF}(?: either)? version 2(?: of the license)?", 3, 0.95),
    ("lgpl-2-or-later", "redistribute it and or modify", f"{_TERMS} the gnu library general public license {_FSF} either version 2 of the license{_LATER}", 2, 0.97),
    ("lgpl-2.1", "redistribute it and or modify", f"{_TERMS} the gnu lesser general public license {_FSF}(?: either)? version 2 1(?: of the license)?", 3, 0.95),
    ("lgpl-2.1-or-later", "redistribute it and or modify", f"{_TERMS} the gnu lesser general public license {_FSF} either version 2 1 of the license{_LATER}", 2, 0.97),
    ("lgpl-3", "redistribute it and or modify", f"{_TERMS} the gnu lesser general public license {_FSF}(?: either)? version 3(?: of the license)?", 3, 0.95),
    ("lgpl-3-or-later", "redistribute it and or modify", f"{_TERMS} the gnu lesser general public license {_FSF} either version 3 of the license{_LATER}", 2, 0.97),
    ("agpl-3", "redistribute it and or modify", f"{_TERMS} the gnu affero general public license {_FSF}(?: either)? version 3(?: of the license)?", 3, 0.95),
    ("agpl-3-or-later", "redistribute it and or modify", f"{_TERMS} the gnu affero general public license {_FSF} either version 3 of the license{_LATER}", 2, 0.97),
    # their titles
    ("gpl-2", "june 1991", "gnu general public license version 2 june 1991", 2, 0.99),
    ("gpl-3", "june 2007", "gnu general public license version 3 29 june 2007", 2, 0.99),
    ("lgpl-2", "june 1991", "gnu library general public license version 2 june 1991", 2, 0.99),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999", 2, 0.99),
    ("lgpl-3", "june 2007", "gnu lesser general public license version 3 29 june 2007", 2, 0.99),
    ("agpl-3", "november 2007", "gnu affero general public license version 3 19 november 2007", 2, 0.99),
    ("sspl-1", "server side public license", "server side public license(?: version 1)?", 2, 0.9),
    ("busl-1.1", "business source license", "business source license(?: version)? 1 1", 2, 0.9),
    ("elastic-2", "elastic license", "elastic license(?: version)? 2(?: 0)?", 2, 0.9),
    # weak copyleft notices
    ("mpl-2", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0", 2, 0.99),
    ("mpl-1.1", "contents of this file are subject", f"{_FILE} the mozilla public license version 1 1", 2, 0.99),
    ("cddl-1", "contents of this file are subject", f"{_FILE} the terms of the common development and distribution license", 2, 0.97),
    ("npl-1.1", "contents of this file are subject", f"{_FILE} the netscape public license version 1 1", 2, 0.97),
    ("epl-1", "the accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0", 2, 0.99),
    ("epl-2", "the accompanying materials",
     "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |v|version )?2 0", 2, 0.99),
    ("eupl-1.2", "under the eupl", "licensed under the eupl version 1 2", 2, 0.97),
    ("ms-pl", "use of the accompanying software", "this license governs use of the accompanying software if you use the software you accept this license", 2, 0.95),
    ("ofl-1.1", "this font software", "this font software is licensed under the sil open font license version 1 1", 2, 0.99),
    ("ofl-1.1", "goals of the open font license", "the goals of the open font license ofl are to stimulate worldwide development", 2, 0.97),
    # deeds
    ("cc-by", "must give appropriate credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", 4, 0.85),
    ("cc-by-nc", "material for commercial purposes", "you may not use the material for commercial purposes", 3, 0.85),
    ("cc-by-sa", "distribute your contributions", "build upon the material you must distribute your contributions under the same license", 3, 0.85),
    ("cc-by-nd", "distribute the modified material", "build upon the material you may not distribute the modified material", 3, 0.85),
    ("cc0-1", "neighboring rights", "waived all copyright and related or neighboring rights to", 2, 0.95),
    ("cc0-1", "associated a work with this deed", "the person who associated a work with this deed has dedicated the work to the public domain", 2, 0.95),
    # addresses
    ("cc-by", "creativecommons org", "creativecommons org licenses by [1-4] [05]", 3, 0.95),
    ("cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [1-4] [05]", 3, 0.95),
    ("cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [1-4] [05]", 3, 0.95),
    ("cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [1-4] [05]", 3, 0.95),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [1-4] [05]", 3, 0.95),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [1-4] [05]", 3, 0.95),
    ("cc0-1", "creativecommons org", "creativecommons org publicdomain zero 1 0", 3, 0.95),
    ("mit", "opensource org", "opensource org licenses? mit", 3, 0.95),
    ("isc", "opensource org", "opensource org licenses? isc(?: license)?", 3, 0.95),
    ("bsd-2-clause", "opensource org", "opensource org licenses? bsd 2 clause", 3, 0.95),
    ("bsd-3-clause", "opensource org", "opensource org licenses? bsd 3 clause", 3, 0.95),
    ("apache-2", "apache org", "apache org licenses license 2 0", 3, 0.95),
    ("gpl-2", "gnu org", "gnu org licenses (?:old licenses )?gpl 2 0", 3, 0.9),
    ("gpl-3", "gnu org", "gnu org licenses gpl 3 0", 3, 0.9),
    ("lgpl-3", "gnu org", "gnu org licenses lgpl 3 0", 3, 0.9),
    ("agpl-3", "gnu org", "gnu org licenses agpl 3 0", 3, 0.9),
    ("mpl-2", "mozilla org", "mozilla org mpl 2 0", 3, 0.95),
    ("epl-2", "eclipse org", "eclipse org legal epl (?:v )?2 0", 3, 0.95),
    ("boost-1", "boost org", "boost org license 1 0 txt", 3, 0.95),
    ("unlicense", "unlicense org", "unlicense org", 3, 0.95),
    # public domain and reserved rights
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain", 2, 0.99),
    ("unlicense", "publish use compile sell", "anyone is free to copy modify publish use compile sell or distribute this software", 3, 0.9),
    ("public-domain", "in the public domain", "(?:this|the) (?:work|file|code|software|program|text) is (?:hereby )?(?:placed )?in the public domain", 5, 0.8),
    ("public-domain", "into the public domain", "(?:has been|is hereby) put into the public domain", 5, 0.8),
    ("proprietary", "via any medium is strictly prohibited", "unauthorized copying of this file via any medium is strictly prohibited", 4, 0.85),
    ("proprietary", "may be reproduced", "no part of this (?:publication|book|work|document) may be reproduced", 4, 0.85),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 5, 0.75),
]
