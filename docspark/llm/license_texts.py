"""Texts of known licences and of the usual one-line notices."""

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

KNOWN = {
    "MIT": 'MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_3 + _BSD_TAIL,
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
}

#: Title lines that stand above these texts, in the usual spellings; the text without a title is known too.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "MIT/Expat License", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "Zero-Clause BSD License (0BSD)", "Zero Clause BSD License (0BSD)", "BSD Zero Clause License (0BSD)", "BSD 0-Clause License", "0BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The Simplified BSD License", "BSD-2-Clause", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause", "BSD License", "The BSD License"),
}

#: Canonical digests of long texts as in Debian's /usr/share/common-licenses: the file, and where it says "END OF
#: TERMS AND CONDITIONS" also the text up to there, with and without that line.
DIGESTS = {
    "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543": "Apache-2.0",
    "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40": "Apache-2.0",
    "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f": "Apache-2.0",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "3d3acd6d1c9a511d832bb394257b1f166254fdc645d49cf238b7590fcee05fb0": "GFDL-1.2",
    "5c8c9ea723b76a1e85fde99662ee80d9737da6574292b3b8c9f21e5d9513ffbc": "GFDL-1.3",
    "b0b451371aa8b1fca2656e1c4adfd20298318818523446f7571338a5b932e23f": "GPL-1.0",
    "59967477eafa5c999df136ce4729e98a72b0bde54cf327c732f475447201a313": "GPL-1.0",
    "446a870fbe7a20405d807d04a8642f55ba2ff4183a84ca8236d78f7718c612c3": "GPL-1.0",
    "c683128a79af968653f7a06709159e41adcfcb00ca1e8ab9ffa1d516dcf82123": "GPL-2.0",
    "393d838a3fcdf4be802c0512341c9f00cc4c10adb56ebbf01687ff37049a19dd": "GPL-2.0",
    "a93fe78d4730818406bfd92d5ca51c742bb44757809e9df2b528ee23601c6446": "GPL-2.0",
    "ab0ff01b5102d67da216e91690a50504aebf46513a85db94155933b2db63283f": "GPL-3.0",
    "22fb9eab6c587ba29bf311c60aba8ee70bbd3dc03ec5eecdfb7f3b4188c969cd": "GPL-3.0",
    "f5faf9b905f587deca8a69ec8502726a00807a41ff4a410e1f8ecd7b6cc3e134": "GPL-3.0",
    "b64047590f42a52d46a8a93fad9485df2e189694e4b51288546e57ce10e59769": "LGPL-2.0",
    "2d380dbc5ad94744c5d444af2bdcf1542b0848aa1587d6c7f3efb54e87ce54a5": "LGPL-2.0",
    "24f90d254e58b80510e11141dd34919c3540d2724873a5956bd674033ae5a36b": "LGPL-2.0",
    "bc7898eef7d53923eff574c7a898468049b8e1e90eef19ba0b8132904dd70a66": "LGPL-2.1",
    "e8fee7034b6432f7d6c16577b34654c02947180c540389d03e5e06c427f0f4f5": "LGPL-2.1",
    "161c1b11462a7e927417540b0d51bf241c84e045a9aa72dd5bf5537c35d8d1c1": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b": "MPL-1.1",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
}
