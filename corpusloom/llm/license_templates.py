"""Wordings of public licences and notices with template markup, by the label that a match adds.

``<<optional>> ... <<end>>`` may be left out and ``<<var N>>`` stands for up to N words. Signs and capitals don't matter.
"""

_AS_IS = """<<var 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
    PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
    (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
    ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""
_NEITHER = """<<optional>>3.<<end>> Neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this
    software without specific prior written permission."""
_FREE = """<<var 8>> is free software<<optional>>:<<end>> you can redistribute it and/or modify it under the terms of the GNU <<var 2>> General Public License as published by the
    Free Software Foundation"""
_HOPE = "<<var 8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

#: The wordings.
TEMPLATES = {
    "0bsd-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""",
    "agpl-3.0-header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var 10>> Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "apache-2.0-notice": """licensed under the Apache License, <<optional>>Version<<end>> 2.0 <<optional>>(the "License")<<end>>""",
    "artistic-2.0-notice": "under the <<optional>>terms of the<<end>> Artistic License <<optional>>version<<end>> 2.0",
    "bsd-2-clause-text": f"{_BSD} THIS SOFTWARE IS PROVIDED BY {_AS_IS}",
    "bsd-3-clause-text": f"{_BSD} {_NEITHER} THIS SOFTWARE IS PROVIDED BY {_AS_IS}",
    "bsd-text": _BSD,
    "bsl-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
        Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    "cc-by-4.0-notice": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution 4.0 <<optional>>International<<end>> <<optional>>License<<end>>",
    "cc-by-nc-4.0-notice": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY-NC 4.0 <<optional>>license<<end>>",
    "cc-by-nc-notice": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution-NonCommercial <<optional>>ShareAlike<<end>> <<optional>>NoDerivatives<<end>> <<var 2>> <<optional>>International<<end>> License",
    "cc-by-sa-4.0-notice": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> Creative Commons Attribution-ShareAlike 4.0 <<optional>>International<<end>> <<optional>>License<<end>>",
    "cc0-1.0-notice": """To the extent possible under law, <<var 12>> has waived all copyright and related or neighboring rights to this <<optional>>work<<end>>""",
    "epl-2.0-notice": "made available under the terms of the Eclipse Public License <<optional>>v<<end>> <<optional>>version<<end>> 2.0",
    "eupl-notice": "Licensed under the EUPL <<optional>>Version<<end>> <<var 2>>",
    "gpl-2.0-header": f"{_FREE}; either version 2 of the License, or (at your option) any later version. {_HOPE}",
    "gpl-3.0-header": f"{_FREE}, either version 3 of the License, or (at your option) any later version. {_HOPE}",
    "gpl-notice": """licensed under the <<optional>>terms of the<<end>> <<optional>>GNU<<end>> General Public License
        <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> <<optional>>version <<var 1>><<end>>""",
    "isc-text": """Permission to use, copy, modify, <<optional>>and<<end>> <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var 12>> DISCLAIMS ALL WARRANTIES WITH
        REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "lgpl-2.1-header": """under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version""",
    "lgpl-3.0-header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mit-notice": "<<optional>>this work is<<end>> <<optional>>this software is<<end>> released under the <<optional>>terms of the<<end>> MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this <<var 12>> (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or
        substantial portions of the Software.
        <<optional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<end>>""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at""",
    "spdx-notice": "SPDX-License-Identifier: <<var 1>>",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "wtfpl-text": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE <<optional>>TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.<<end>>",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will <<var 8>> be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions:""",
}
