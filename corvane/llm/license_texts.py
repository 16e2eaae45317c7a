"""Licence texts and notices to look for: label, text, and the key phrases it must have.

Fixed values: the wording of public licences, whole where they are short and
else the notice that grants them, as their authors word it.
"""

from __future__ import annotations

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
    "PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
ZERO_BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES"
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer."
)
ZLIB = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
    "the original software."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means."
)
BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, "
    "and transmit the Software"
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
)
WTFPL = "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."
OFL = "This Font Software is licensed under the SIL Open Font License, Version 1.1."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"
CDDL = "The contents of this file are subject to the terms of the Common Development and Distribution License"
CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
ARTISTIC = "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0"


def _gnu(label: str, name: str, version: str) -> list[tuple[str, str, list[str]]]:
    """How the notices of the GNU family grant a version of a licence."""
    grant = f"{name} as published by the Free Software Foundation"
    head = "This program is free software: you can redistribute it and/or modify it under the terms of the"
    return [
        (label, f"{head} {grant}, either version {version} of the License, or (at your option) any later version.", [grant, f"version {version} of the license"]),
        (label, f"{head} {grant}; version {version}.", [f"{grant} version {version}"]),
        (label, f"licensed under the {name} version {version}", [f"{name} version {version}"]),
        (label, f"licensed under the {name} v{version}", [f"{name} v{version}"]),
    ]


GNU = [
    *_gnu("gpl-2", "GNU General Public License", "2"),
    *_gnu("gpl-3", "GNU General Public License", "3"),
    *_gnu("lgpl-2.1", "GNU Lesser General Public License", "2.1"),
    *_gnu("lgpl-3", "GNU Lesser General Public License", "3"),
    *_gnu("agpl-3", "GNU Affero General Public License", "3"),
]

# Short identifiers as files state them: label, identifier.
IDENTIFIERS = [
    ("0bsd", "0BSD"),
    ("agpl-3", "AGPL-3.0"),
    ("apache-2", "Apache-2.0"),
    ("artistic-2", "Artistic-2.0"),
    ("boost", "BSL-1.0"),
    ("bsd", "BSD-2-Clause"),
    ("bsd", "BSD-3-Clause"),
    ("cc0", "CC0-1.0"),
    ("cddl", "CDDL-1.0"),
    ("epl-2", "EPL-2.0"),
    ("gpl-2", "GPL-2.0"),
    ("gpl-3", "GPL-3.0"),
    ("isc", "ISC"),
    ("lgpl-2.1", "LGPL-2.1"),
    ("lgpl-3", "LGPL-3.0"),
    ("mit", "MIT"),
    ("mpl-2", "MPL-2.0"),
    ("ofl", "OFL-1.1"),
    ("unlicense", "Unlicense"),
    ("zlib", "Zlib"),
]

# Creative Commons: the parts of a licence as abbreviated and as written out.
CREATIVE = [
    ("by", "Attribution"),
    ("by nc", "Attribution NonCommercial"),
    ("by nc nd", "Attribution NonCommercial NoDerivatives"),
    ("by nc sa", "Attribution NonCommercial ShareAlike"),
    ("by nd", "Attribution NoDerivatives"),
    ("by sa", "Attribution ShareAlike"),
]


def _creative(short: str, name: str) -> list[tuple[str, str, list[str]]]:
    label = "cc-" + short.replace(" ", "-")
    # What names fewer parts is part of what names more; only a version after it tells them apart.
    last = f"cc {short} 4 0" if short == "by" else f"cc {short}"
    named = f"Creative Commons {name} 4 0" if short == "by" else f"Creative Commons {name}"
    return [
        (label, f"licensed under CC {short} 4.0", [last]),
        (label, f"licensed under a {named} International License", [named]),
    ]


TEMPLATES = [
    ("apache-2", "licensed under the Apache License, Version 2.0", ["Apache License Version 2"]),
    ("apache-2", APACHE, ["Apache License Version 2", "except in compliance with the License"]),
    ("artistic-2", ARTISTIC, ["terms of the Artistic License 2 0"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", ["Boost Software License Version 1"]),
    ("boost", BOOST, ["any person or organization obtaining a copy of the software"]),
    ("bsd", BSD, ["redistribution and use in source and binary forms", "with or without modification"]),
    ("cc0", CC0, ["waived all copyright and related or neighboring rights"]),
    ("cddl", CDDL, ["Common Development and Distribution License"]),
    ("epl-2", EPL, ["Eclipse Public License v 2"]),
    ("isc", ISC, ["permission to use copy modify and or distribute this software for any purpose", "copyright notice and this permission notice appear in all copies"]),
    ("0bsd", ZERO_BSD, ["permission to use copy modify and or distribute this software for any purpose", "is hereby granted the software is provided as is"]),
    ("mit", MIT, ["permission is hereby granted free of charge to any person obtaining a copy"]),
    ("mit", "released under the MIT License", ["under the mit license"]),
    ("mpl-2", MPL, ["Mozilla Public License v 2"]),
    ("ofl", OFL, ["SIL Open Font License"]),
    ("unlicense", UNLICENSE, ["free and unencumbered software released into the public domain"]),
    ("wtfpl", WTFPL, ["changing it is allowed as long as the name is changed"]),
    ("zlib", ZLIB, ["origin of this software must not be misrepresented", "alter it and redistribute it freely"]),
    *GNU,
    *[t for short, name in CREATIVE for t in _creative(short, name)],
    *[(label, f"SPDX-License-Identifier: {name}", [f"License Identifier {name}"]) for label, name in IDENTIFIERS],
]
