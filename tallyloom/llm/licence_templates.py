"""Licence templates: fixed values.

Whole short licences, the notices by which long ones are applied, and one-line statements, as they are commonly written; the
names are SPDX identifiers.  One licence may have several templates.  The long licences' own texts (GPL family, Apache, MPL, EPL,
Creative Commons) are not among them: files carry their notices.
"""

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""

GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program."""

MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

UNLICENSE_NOTICE = """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means."""

BSD_2_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""

BSD_3_CONDITION = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""

BSD_4_CONDITIONS = """3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names
of its contributors may be used to endorse or promote products derived from this software without specific prior written
permission."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""

ZERO_BSD_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution."""

BOOST_BODY = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor."""

UNLICENSE_BODY = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law."""

#: The MIT licence without its condition, which one licence leaves out.
MIT_GRANT, MIT_WARRANTY = MIT_BODY.partition(", subject to")[0], MIT_BODY[MIT_BODY.index("THE SOFTWARE IS") :]

X11_CONDITION = """Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote
the sale, use or other dealings in this Software without prior written authorization from the X Consortium."""

#: The notice of the GNU licences by name, version word and warranty's name.
GNU_NOTICE = """This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the
GNU {name} along with this {work}."""

EPL_NOTICE = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""

#: Licences as one-line statements name them.
NAMED = [
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("Zlib", "zlib License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License v3.0"), ("GPL-3.0", "GNU General Public License, version 3"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-2.1", "GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("LGPL-3.0", "GNU Lesser General Public License v3.0"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License v3.0"),
]

#: Identifiers that stand behind SPDX-License-Identifier.
IDENTIFIERS = (
    "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-4-Clause", "X11",
)

#: Words that tell licences apart: their names and those of a family's members; numbers do behind the words of VERSION_BEFORE or a v of their own.
TELLING = (
    "mit", "isc", "zlib", "0bsd", "unlicense", "gpl", "lgpl", "agpl", "mpl", "epl", "bsl", "cc0", "apache", "mozilla", "eclipse", "boost", "gnu", "bsd", "creative", "cc", "affero",
    "sharealike", "endorse", "noncommercial", "noderivatives", "noderivs", "sa", "nc", "nd", "lesser", "clause",
    "advertising", "acknowledgement",
)
VERSION_BEFORE = ("version", "v", "license", "public", "attribution", "by", "apache", "bsd", "gpl", "lgpl", "agpl", "mpl", "epl", "bsl", "cc0")
#: A statement shortly behind one of these in its sentence grants nothing, unless the next word is one that takes the negation for itself;
#: "no" negates a statement only as "no longer".
NEGATIONS = ("not", "never", "longer", "isn", "aren", "t")
NEGATES_NOTHING = {"not": ("only", "just", "merely")}

TEMPLATES = [
    ("BSD-2-Clause", f"{BSD_2_CONDITIONS} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_2_CONDITIONS} {BSD_3_CONDITION} {BSD_DISCLAIMER}"),
    ("BSD-4-Clause", f"{BSD_2_CONDITIONS} {BSD_4_CONDITIONS} {BSD_DISCLAIMER}"),
    ("MIT-0", f"{MIT_GRANT}. {MIT_WARRANTY}"),
    ("X11", f"{MIT_BODY} {X11_CONDITION}"),
    ("0BSD", ZERO_BSD_BODY),
    ("Zlib", ZLIB_BODY),
    ("BSL-1.0", BOOST_BODY),
    ("Unlicense", UNLICENSE_BODY),
    ("EPL-2.0", EPL_NOTICE),
    ("GPL-2.0", GNU_NOTICE.format(work="program", name="General Public License", version="2")),
    ("LGPL-2.1", GNU_NOTICE.format(work="library", name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", GNU_NOTICE.format(work="library", name="Lesser General Public License", version="3")),
    ("LGPL-3.0", GNU_NOTICE.format(work="program", name="Lesser General Public License", version="3")),
    ("AGPL-3.0", GNU_NOTICE.format(work="program", name="Affero General Public License", version="3")),
    *((spdx, f"{verb} under the {name}.") for spdx, name in NAMED for verb in ("Licensed", "Released")),
    *((spdx, f"This work is licensed under the {name}.") for spdx, name in NAMED),
    *((spdx.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {spdx}") for spdx in IDENTIFIERS),
    ("MIT", MIT_BODY),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", ISC_BODY),
    ("Apache-2.0", APACHE_NOTICE),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", GPL3_NOTICE),
    ("MPL-2.0", MPL_NOTICE),
    ("Unlicense", UNLICENSE_NOTICE),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]
