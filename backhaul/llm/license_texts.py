"""Wordings of licences for the second step of the license scan: notices, headers, whole files.

Each wording has phrases that a text must hold word for word, so that a licence is never named for
words that all licences share; the rest of the wording is compared by cosine.
"""

from __future__ import annotations

#: SPDX identifiers (without -only and -or-later) with names customary in notices.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License v3", "GNU Affero General Public License version 3",
                 "AGPLv3", "AGPL v3"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License",
                   "Apache License v2.0", "Apache 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0",
                "Eclipse Public License, Version 2.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2", "GPLv2",
                "GPL v2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3", "GPLv3",
                "GPL v3", "GPL version 3"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1",
                 "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3",
                 "GNU Lesser General Public License v3", "LGPLv3", "LGPL v3"],
    "MIT": ["MIT License", "MIT licence"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0",
                "Mozilla Public License, v. 2.0"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License"],
}
LEADS = ["licensed under the", "released under the", "distributed under the", "available under the",
         "published under the", "under the terms of the", "licensed under", "released under",
         "License:"]
SPDX = "SPDX-License-Identifier:"

_MIT_0 = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this "
          "software and associated documentation files (the \"Software\"), to deal in the Software "
          "without restriction, including without limitation the rights to use, copy, modify, merge, "
          "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
          "to whom the Software is furnished to do so")
_MIT = _MIT_0 + (", subject to the following conditions: The above copyright notice and this permission "
                 "notice shall be included in all copies or substantial portions of the Software.")
_AS_IS = (" THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
          "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
          "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
          "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
          "DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.")
_BSD_3 = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
          "endorse or promote products derived from this software without specific prior written "
          "permission.")
_BSD_AS_IS = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
              "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
              "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
              "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
              "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES")
_FSF = (" Copyright (C) {} Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy "
        "and distribute verbatim copies of this license document, but changing it is not allowed.")


def _gnu(what: str, name: str, version: str) -> str:
    return (f"{what} is free software; you can redistribute it and/or modify it under the terms of the "
            f"GNU {name} as published by the Free Software Foundation, either version {version} of the "
            "License, or (at your option) any later version.")


#: (licence, phrases, wording, whether only a licence file has it)
TEXTS = [
    ("MIT", ["permission is hereby granted free of charge", "above copyright notice and this permission"],
     _MIT, False),
    ("MIT", ["permission is hereby granted free of charge", "above copyright notice and this permission"],
     _MIT + _AS_IS, False),
    ("MIT-0", ["permission is hereby granted free of charge", "furnished to do so the software is provided"],
     _MIT_0 + _AS_IS, False),
    ("BSD-2-Clause", ["redistribution and use in source and binary forms", "provided with the distribution this"],
     _BSD + _BSD_AS_IS, False),
    ("BSD-3-Clause", ["redistribution and use in source and binary forms", "endorse or promote products"],
     _BSD + _BSD_3 + _BSD_AS_IS, False),
    ("ISC", ["permission to use copy modify and or distribute this software"],
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
     "in all copies.", False),
    ("Unlicense", ["free and unencumbered software released into the public domain"],
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
     "modify, publish, use, compile, sell, or distribute this software", False),
    ("Zlib", ["this software is provided as is without any express or implied warranty"],
     "This software is provided 'as-is', without any express or implied warranty. In no event will the "
     "authors be held liable for any damages arising from the use of this software. Permission is "
     "granted to anyone to use this software for any purpose, including commercial applications", False),
    ("Apache-2.0", ["apache license version 2 0"],
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0", False),
    ("Apache-2.0", ["apache license version 2 0", "terms and conditions for use"],
     "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR "
     "USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.", True),
    ("MPL-2.0", ["mozilla public license v 2 0"],
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
     "the MPL was not distributed with this file, You can obtain one at", False),
    ("MPL-2.0", ["mozilla public license version 2 0", "1 definitions"],
     "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or "
     "legal entity that creates", True),
    ("EPL-2.0", ["eclipse public license v 2 0", "accompanying program"],
     "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE "
     "PUBLIC LICENSE", True),
    ("BSL-1.0", ["boost software license version 1 0", "permission is hereby granted"],
     "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of "
     "charge, to any person or organization obtaining a copy", True),
    ("CC0-1.0", ["creative commons legal code cc0 1 0 universal"],
     "Creative Commons Legal Code CC0 1.0 Universal", True),
    *((name, [f"creative commons {kind} 4 0 international public license by exercising"],
       f"Creative Commons {kind} 4.0 International Public License By exercising the Licensed Rights "
       "(defined below), You accept and agree to be bound by the terms and conditions", True)
      for name, kind in (("CC-BY-4.0", "attribution"), ("CC-BY-NC-4.0", "attribution noncommercial"),
                         ("CC-BY-SA-4.0", "attribution sharealike"),
                         ("CC-BY-ND-4.0", "attribution noderivatives"),
                         ("CC-BY-NC-SA-4.0", "attribution noncommercial sharealike"))),
    *((name, [f"gnu {long.lower()}", f"version {version} of the license"],
       _gnu(what, long, version.replace(" ", ".")), False)
      for name, long, version in (("GPL-2.0", "General Public License", "2"),
                                  ("GPL-3.0", "General Public License", "3"),
                                  ("AGPL-3.0", "Affero General Public License", "3"),
                                  ("LGPL-2.1", "Lesser General Public License", "2 1"),
                                  ("LGPL-3.0", "Lesser General Public License", "3"))
      for what in ("This program", "This file", "This library")),
    *((name, [f"gnu {long.lower()} version {version}", "everyone is permitted to copy"],
       f"GNU {long} Version {version.replace(' ', '.')}, {date}" + _FSF.format(date[-4:]), True)
      for name, long, version, date in (
          ("GPL-2.0", "General Public License", "2", "June 1991"),
          ("GPL-3.0", "General Public License", "3", "29 June 2007"),
          ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
          ("LGPL-2.1", "Lesser General Public License", "2 1", "February 1999"),
          ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"))),
    # the title of a file whose next lines are missing
    *((name, [f"gnu {long.lower()} version {version}"],
       f"GNU {long} Version {version.replace(' ', '.')}", False)
      for name, long, version in (("GPL-2.0", "General Public License", "2"),
                                  ("GPL-3.0", "General Public License", "3"),
                                  ("AGPL-3.0", "Affero General Public License", "3"),
                                  ("LGPL-2.1", "Lesser General Public License", "2 1"),
                                  ("LGPL-3.0", "Lesser General Public License", "3"))),
]


def wordings() -> list[tuple[str, list[str], str, bool]]:
    """All of them, notices and SPDX lines included."""
    import re

    def plain(text: str) -> str:
        return " ".join(re.findall("[a-z0-9]+", text.lower()))

    spdx = [(n, [plain(f"{SPDX} {n}")], f"{SPDX} {n}", False) for n in NAMES]
    notices = [(n, [plain(name)], f"{lead} {name}", False)
               for n, names in NAMES.items() for name in [*names, n] for lead in LEADS]
    return [*TEXTS, *spdx, *notices]
