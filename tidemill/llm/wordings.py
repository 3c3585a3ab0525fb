"""Usual wordings of licences, and the words of each that tell it from its relatives."""

from __future__ import annotations

_AS_IS = 'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.'
_BSD = 'redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_ADVERTISING = "3. all advertising materials mentioning features or use of this software must display the following acknowledgement: this product includes software developed by the organization. 4. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NEITHER = "3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so'
_MIT_NOTICE = "subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."
_MIT_AS_IS = 'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.'
_ISC_AS_IS = 'the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.'
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the gnu {kind}general public license as published by the free software foundation, either version {n} of the license, or (at your option) any later version."
_GNU_WARRANTY = "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {kind}general public license for more details."
_VERBATIM = "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Short names of licences, as notices of a line give them; all their words must be kept.
_SHORT = (
    ("MIT", "mit"), ("Apache-2.0", "apache 2.0"), ("Apache-2.0", "apache license 2.0"), ("Apache-2.0", "apache license version 2.0"), ("BSD-2-Clause", "bsd 2-clause"), ("BSD-3-Clause", "bsd 3-clause"), ("BSD-4-Clause", "bsd 4-clause"), ("ISC", "isc"),
    ("GPL-2.0", "gplv2"), ("GPL-3.0", "gplv3"), ("GPL-2.0", "gpl 2.0"), ("GPL-3.0", "gpl 3.0"), ("LGPL-2.1", "lgpl 2.1"), ("LGPL-3.0", "lgpl 3.0"), ("MPL-2.0", "mpl 2.0"), ("PostgreSQL", "postgresql"), ("PSF-2.0", "psf"),
)
_FORMS = ("licensed under {}", "licensed under the {} license", "released under the {} license", "distributed under the terms of the {} license", "license: {}", "license {}", "{} licensed")
_CC = [f"by{more}" for more in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd")]
_SHORT_NOTICES = (
    *((name, form.format(short).replace("license license", "license"), tuple(short.split())) for name, short in _SHORT for form in _FORMS),
    *((f"CC-{kind.upper()}-{version}", wording.format(kind, version), (*must, kind, version)) for kind in _CC for version in ("3.0", "4.0")
      for wording, must in (("licensed under cc {} {}", ("cc",)), ("licensed under http://creativecommons.org/licenses/{}/{}/", ("creativecommons.org",)))),
)

#: (licence, wording, words that must be kept). The first of equal ones counts.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    *_SHORT_NOTICES,
    ("BSD-4-Clause", f"{_BSD} {_ADVERTISING} {_AS_IS}", ("redistributions", "binary", "endorse", "promote", "advertising", "acknowledgement")),
    ("BSD-4-Clause", f"{_BSD} {_ADVERTISING}", ("redistributions", "binary", "endorse", "promote", "advertising", "acknowledgement")),
    ("OFL-1.1", "this font software is licensed under the sil open font license, version 1.1", ("sil", "font", "1.1")),
    ("PSF-2.0", "python software foundation license version 2", ("python", "foundation", "2")),
    ("PostgreSQL", "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", ("fee", "agreement", "granted", "paragraphs")),
    ("Apache-2.0", "licensed under the apache license, version 2.0", ("apache", "2.0")),
    ("Apache-2.0", 'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0', ("apache", "2.0", "compliance")),
    ("Apache-2.0", 'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.', ("apache", "2.0", "governing")),
    ("Apache-2.0", "apache license version 2.0, january 2004 http://www.apache.org/licenses/ terms and conditions for use, reproduction, and distribution", ("apache", "2.0", "january", "2004")),
    ("MIT", "released under the mit license", ("mit",)),
    ("MIT", "licensed under the mit license", ("mit",)),
    ("MIT", f"{_MIT}, {_MIT_NOTICE} {_MIT_AS_IS}", ("sublicense", "noninfringement", "substantial")),
    ("MIT-0", f"{_MIT}. {_MIT_AS_IS}", ("sublicense", "noninfringement")),
    ("MIT", 'permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal in the software without restriction', ("permission", "free", "charge", "without", "restriction")),
    ("ISC", f"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}", ("fee", "granted", "tortious", "appear")),
    ("0BSD", f"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_AS_IS}", ("fee", "granted", "tortious")),
    ("BSD-3-Clause", f"{_BSD} {_NEITHER} {_AS_IS}", ("redistributions", "binary", "endorse", "promote")),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}", ("redistributions", "binary", "disclaimed")),
    ("BSD-3-Clause", f"{_BSD} {_NEITHER}", ("redistributions", "binary", "endorse", "promote")),
    ("BSD-3-Clause", "licensed under the bsd 3-clause license", ("bsd", "3-clause")),
    ("BSD-2-Clause", "licensed under the bsd 2-clause license", ("bsd", "2-clause")),
    ("BSD", "licensed under the bsd license", ("bsd",)),
    ("BSD", "use of this source code is governed by a bsd-style license that can be found in the license file", ("governed", "bsd-style")),
    ("BSD", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "source", "binary", "permitted")),
    ("ISC", "licensed under the isc license", ("isc",)),
    ("GPL-3.0", "this work is licensed under the gnu general public license, version 3", ("gnu", "general", "3")),
    ("GPL-2.0", "this work is licensed under the gnu general public license, version 2", ("gnu", "general", "2")),
    ("GPL-3.0-or-later", "this program " + _GNU.format(kind="", n="3"), ("gnu", "general", "published", "3")),
    ("GPL-2.0-or-later", "this program " + _GNU.format(kind="", n="2"), ("gnu", "general", "published", "2")),
    ("GPL-3.0-or-later", f"this program {_GNU.format(kind='', n='3')} {_GNU_WARRANTY.format(kind='')}", ("gnu", "general", "published", "3", "hope")),
    ("GPL-2.0-or-later", f"this program {_GNU.format(kind='', n='2')} {_GNU_WARRANTY.format(kind='')}", ("gnu", "general", "published", "2", "hope")),
    ("GPL-3.0", f"gnu general public license version 3, 29 june 2007 copyright (c) 2007 free software foundation, inc. {_VERBATIM}", ("gnu", "general", "3", "29", "verbatim")),
    ("GPL-2.0", f"gnu general public license version 2, june 1991 copyright (c) 1989, 1991 free software foundation, inc. {_VERBATIM}", ("gnu", "general", "2", "1991", "verbatim")),
    ("LGPL-3.0", "this library is licensed under the gnu lesser general public license, version 3", ("gnu", "lesser", "3")),
    ("LGPL-2.1", "this library is licensed under the gnu lesser general public license, version 2.1", ("gnu", "lesser", "2.1")),
    ("LGPL-3.0-or-later", "this library " + _GNU.format(kind="lesser ", n="3"), ("gnu", "lesser", "published", "3")),
    ("LGPL-2.1-or-later", "this library " + _GNU.format(kind="lesser ", n="2.1"), ("gnu", "lesser", "published", "2.1")),
    ("AGPL-3.0", "licensed under the gnu affero general public license, version 3", ("gnu", "affero", "3")),
    ("AGPL-3.0-or-later", "this program " + _GNU.format(kind="affero ", n="3"), ("gnu", "affero", "published", "3")),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0", ("mozilla", "2.0")),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/", ("mozilla", "2.0", "mpl")),
    ("MPL-1.1", "the contents of this file are subject to the mozilla public license version 1.1 (the \"license\"); you may not use this file except in compliance with the license", ("mozilla", "1.1")),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse", "2.0")),
    ("EPL-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution", ("eclipse", "v1.0")),
    ("EPL-2.0", "licensed under the eclipse public license 2.0", ("eclipse", "2.0")),
    ("CDDL-1.0", "the contents of this file are subject to the terms of the common development and distribution license (the \"license\"). you may not use this file except in compliance with the license", ("development", "distribution", "compliance")),
    ("EUPL-1.2", "licensed under the eupl, version 1.2", ("eupl", "1.2")),
    ("Artistic-2.0", "licensed under the artistic license 2.0", ("artistic", "2.0")),
    ("Unlicense", "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered", "public", "domain")),
    ("Unlicense", 'this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.', ("unencumbered", "relinquishment", "heirs")),
    ("Zlib", "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. this notice may not be removed or altered from any source distribution.", ("misrepresented", "altered")),
    ("BSL-1.0", 'permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "software") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following', ("organization", "transmit", "derivative")),
    ("BSL-1.0", "distributed under the boost software license, version 1.0", ("boost", "1.0")),
    ("WTFPL", "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("verbatim", "modified", "changed")),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license", ("creative", "commons", "attribution", "4.0")),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", ("creative", "commons", "attribution-sharealike", "4.0")),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", ("creative", "commons", "attribution-noncommercial", "4.0")),
    ("CC-BY-NC-SA-4.0", "this work is licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license", ("creative", "commons", "attribution-noncommercial-sharealike", "4.0")),
    ("CC0-1.0", "released under the creative commons cc0 1.0 universal public domain dedication", ("cc0",)),
    ("Proprietary", "copyright. all rights reserved. no part of this work may be reproduced without permission", ("rights", "reserved", "reproduced")),
    ("All-rights-reserved", "all rights reserved", ("all", "rights", "reserved")),
)

#: Identifiers of SPDX tags that are reported: those of TEMPLATES, and these.
SPDX_MORE = (
    "AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Artistic-1.0 BlueOak-1.0.0 BSD-4-Clause CC-BY-3.0 CC-BY-SA-3.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EUPL-1.1 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MS-PL MulanPSL-2.0 NCSA OFL-1.1 "
    "OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 UPL-1.0 Vim X11 ZPL-2.1"
).split()
