"""Licence texts and notices: (label, template, mandatory key phrase, a part of the template). Fixed values."""

from __future__ import annotations

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""

GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
software."""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software"""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

CC0 = """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related
or neighboring rights to this work."""

TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("agpl", GNU.format(kind="Affero "), "GNU Affero General Public License as published by"),
    ("agpl", "GNU Affero General Public License", "Affero General Public License"),
    ("apache-2.0", APACHE, "in compliance with the License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    ("boost", BOOST, "any person or organization obtaining a copy"),
    ("bsd", BSD_2, "source and binary forms"),
    ("bsd", BSD_3, "endorse or promote products"),
    ("bsd", BSD_WARRANTY, "procurement of substitute goods"),
    ("cc-by", "licensed under CC BY 4.0", "CC BY 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "CC BY-NC"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", "CC BY-ND"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "CC BY-SA"),
    ("cc0", CC0, "waived all copyright and related or neighboring rights"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication", "CC0 1.0"),
    ("gpl", GNU.format(kind=""), "GNU General Public License as published by"),
    ("isc", ISC, "with or without fee is hereby granted"),
    ("lgpl", GNU.format(kind="Lesser "), "GNU Lesser General Public License as published by"),
    ("lgpl", "GNU Lesser General Public License", "Lesser General Public License"),
    ("mit", MIT, "substantial portions of the Software"),
    ("mit", MIT[: MIT.index(" (the")], "free of charge, to any person obtaining a copy of this software"),
    ("mit", "Released under the MIT License", "MIT License"),
    ("mpl-2.0", MPL, "Mozilla Public License"),
    ("unlicense", UNLICENSE, "unencumbered software"),
    ("zlib", ZLIB, "must not be misrepresented"),
)
