"""Fixed texts by which works state their license: notices, headers, titles and whole short licenses.

Words in braces tell a license apart from others and must be there. Of long
licenses the title and the notice of their own appendix stand for the whole.
"""

_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to {endorse} or {promote} products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (f"{_PERMIT}. {_AS_IS}", "SPDX-License-Identifier: {0BSD}"),
    "Apache-2.0": (
        "Licensed under the {Apache} License, Version {2.0}.",
        "{Apache} License Version {2.0}, January 2004",
        "Licensed under the {Apache} License, Version {2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: {Apache-2.0}",
    ),
    "BSD-2-Clause": (f"{_BSD_TWO} {_BSD_END}", "Licensed under the {BSD} {2-Clause} License.", "SPDX-License-Identifier: {BSD-2-Clause}"),
    "BSD-3-Clause": (f"{_BSD_TWO} {_BSD_THIRD} {_BSD_END}", "Licensed under the {BSD} {3-Clause} License.", "SPDX-License-Identifier: {BSD-3-Clause}"),
    "CC0-1.0": ("Licensed under {CC0} {1.0}.", "{CC0} {1.0} Universal", "Creative Commons {CC0} {1.0} Universal Public Domain Dedication", "SPDX-License-Identifier: {CC0-1.0}"),
    "ISC": (f"{_PERMIT}, provided that the above copyright notice and this permission notice {{appear}} in all {{copies}}. {_AS_IS}", "Licensed under the {ISC} License.", "Released under the {ISC} License.", "SPDX-License-Identifier: {ISC}"),
    "MIT": (
        "Released under the {MIT} License.",
        "Licensed under the {MIT} License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: {MIT}",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "{Mozilla} Public License Version {2.0}",
        "Licensed under the {Mozilla} Public License, version {2.0}.",
        "SPDX-License-Identifier: {MPL-2.0}",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: {Unlicense}",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
        "SPDX-License-Identifier: {Zlib}",
    ),
}

for _name, _kind, _version, _date in (
    ("GPL", "{GNU} {General} {Public}", "2", "June 1991"),
    ("GPL", "{GNU} {General} {Public}", "3", "29 June 2007"),
    ("LGPL", "{GNU} {Lesser} {General} {Public}", "2.1", "February 1999"),
    ("LGPL", "{GNU} {Lesser} {General} {Public}", "3", "29 June 2007"),
    ("AGPL", "{GNU} {Affero} {General} {Public}", "3", "19 November 2007"),
):
    _id = f"{_name}-{_version if '.' in _version else _version + '.0'}"
    TEMPLATES[_id] = (
        f"This work is licensed under the {_kind} License, version {{{_version}}}.",
        f"Licensed under the {_kind} License, version {{{_version}}}.",
        f"{_kind} License Version {{{_version}}}, {_date}",
        f"is free software; you can redistribute it and/or modify it under the terms of the {_kind} License as published by the Free Software Foundation; either version {{{_version}}} of the License, or (at your option) any later version.",
        f"under the terms of version {{{_version}}} of the {_kind} License as published by the Free Software Foundation",
        *(f"SPDX-License-Identifier: {{{_id}{end}}}" for end in ("", "-only", "-or-later", "+")),
    )

for _version in ("4.0", "3.0", "2.5", "2.0"):
    for _parts in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND")):
        _short, _long = "-".join(_parts), [{"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives" if _version == "4.0" else "NoDerivs"}[p] for p in _parts]
        _scope = {"4.0": "International", "3.0": "Unported"}.get(_version, "Generic")
        TEMPLATES[f"CC-{_short}-{_version}"] = tuple(
            dict.fromkeys(
                (
                    f"Licensed under {{CC}} {{{_short}}} {{{_version}}}.",
                    f"Licensed under {{CC}} {' '.join(f'{{{p}}}' for p in _parts)} {{{_version}}}.",
                    f"Licensed under {{CC-{_short}}} {{{_version}}}.",
                    f"Licensed under {{CC-{_short}-{_version}}}.",
                    f"This work is licensed under a {{Creative}} {{Commons}} {{{'-'.join(_long)}}} {{{_version}}} {_scope} License.",
                    f"This work is licensed under a {{Creative}} {{Commons}} {' '.join(f'{{{p}}}' for p in _long)} {{{_version}}} {_scope} License.",
                    f"{{creativecommons.org}} licenses {{{_short}}} {{{_version}}}",
                    f"SPDX-License-Identifier: {{CC-{_short}-{_version}}}",
                )
            )
        )
