"""Templates of licenses and their notices for ``licenses``: label and wording, with optional and replaceable regions."""

from __future__ import annotations

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# The wording of public licenses and of the notices that name them.
TEMPLATES = [
    ("mit", "under the <<optional>>terms of the<<end>> MIT License"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        <<optional>>(the "Software")<<end>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>>
        shall be included in all copies or substantial portions of the Software. <<optional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<end>>""",
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Apache License Version 2 <<optional>>0<<end>>"),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 <<optional>>(the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<any 12>> Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.<<end>>""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<any 16>> "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 16>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES""",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. <<optional>>3.<<end>> Neither the name of
        <<any 16>> nor the names of <<optional>>its<<end>> <<any 4>> contributors may be used to endorse or promote products derived from this software
        without specific prior written permission""",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "isc",
        """Permission to use, copy, modify, and <<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. <<optional>>THE SOFTWARE IS PROVIDED "AS IS" AND
        <<any 12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.<<end>>""",
    ),
    ("isc", "Permission to use, copy, modify, and <<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted"),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will <<any 12>> be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions: <<optional>>1.<<end>> The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software.""",
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
        works of the Software""",
    ),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. <<optional>>Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.<<end>>""",
    ),
    ("gpl-3", "under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation,<<end>> <<optional>>either<<end>> version 3"),
    ("gpl-2", "under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation,<<end>> <<optional>>either<<end>> version 2"),
    (
        "gpl",
        """This program is free software <<any 2>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation <<any 8>> This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE""",
    ),
    ("lgpl", "under the <<optional>>terms of the<<end>> GNU Lesser General Public License"),
    ("agpl", "under the <<optional>>terms of the<<end>> GNU Affero General Public License"),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<optional>>If a copy of the MPL was not distributed with
        this file, You can obtain one at <<any 8>><<end>>""",
    ),
    ("epl-2.0", "made available under the terms of the Eclipse Public License <<any 2>> 2.0"),
    ("cc-by-nc", "CC BY NC"),
    ("cc-by-nc-4.0", "under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-NC 4.0"),
    ("cc-by", "under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution <<any 2>> License"),
    ("cc-by-sa", "under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution ShareAlike <<any 3>> License"),
    ("cc-by-nc", "under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution NonCommercial <<any 3>> License"),
    ("cc0", "to the extent possible under law <<any 12>> waived all copyright and related or neighboring rights to"),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE <<optional>>Version 2<<end>>"),
    ("all-rights-reserved", "copyright <<any 12>> all rights reserved"),
    ("all-rights-reserved", "all rights reserved"),
]
