"""Passages of public license texts and notices, as they are published."""

from __future__ import annotations

#: Text, label. A license of several paragraphs has one passage for each.
PASSAGES = (
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction""", "mit"),
    ("""including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
     copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
     conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
     portions of the Software.""", "mit"),
    ("""THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
     THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
     OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
     OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
     the License. You may obtain a copy of the License at""", "apache-2"),
    ("""Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
     an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
     specific language governing permissions and limitations under the License.""", "apache-2"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met""", "bsd"),
    ("""Redistributions of source code must retain the above copyright notice, this list of conditions and the following
     disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
     following disclaimer in the documentation and/or other materials provided with the distribution.""", "bsd"),
    ("""THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
     INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
     DISCLAIMED.""", "bsd"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies.""", "isc"),
    # the notices of this family differ in the name only, so the name is the passage
    ("""GNU General Public License""", "gpl"),
    ("""GNU Lesser General Public License""", "lgpl"),
    ("""GNU Affero General Public License""", "agpl"),
    ("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""", "mpl-2"),
    ("""If a copy of the MPL was not distributed with this file, You can obtain one at""", "mpl-2"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
     liable for any damages arising from the use of this software.""", "zlib"),
    ("""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
     compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
     commercial or non-commercial, and by any means.""", "unlicense"),
    ("""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
     accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
     and transmit the Software""", "bsl-1"),
    ("""This work is licensed under a Creative Commons Attribution""", "cc-by"),
    ("""To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
     work""", "cc0"),
)
