"""What licences look like in files: fixed values."""

from __future__ import annotations

#: Fixed values. Notices, titles and whole short texts by the licence's identifier; several for one licence are parted by a bar. Long licences are known by their title or by the notice that they ask for.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE|Licensed under the BSD Zero Clause License",
    "AGPL-1.0": "Affero General Public License Version 1, March 2002|Licensed under the Affero General Public License, version 1",
    "AGPL-3.0": "GNU Affero General Public License Version 3, 19 November 2007|This work is licensed under the GNU Affero General Public License, version 3"
    "|This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Apache-1.0": "Licensed under the Apache License, Version 1.0|Licensed under the Apache Software License, Version 1.0",
    "Apache-1.1": "Licensed under the Apache Software License, Version 1.1|Apache Software License, Version 1.1|Licensed under the Apache License, Version 1.1",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0|Apache License Version 2.0, January 2004|Released under the Apache License 2.0"
    "|Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Artistic-1.0": "The Artistic License 1.0|Licensed under the Artistic License, Version 1.0",
    "Artistic-2.0": "The Artistic License 2.0|Licensed under the Artistic License, Version 2.0",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License|BSD 2-Clause Simplified License"
    "|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License|BSD 3-Clause New or Revised License"
    "|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors as is",
    "BSD-4-Clause": "Licensed under the BSD 4-Clause License|BSD 4-Clause Original or Old License"
    "|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003|Distributed under the Boost Software License, Version 1.0",
    "CC0-1.0": "CC0 1.0 Universal|Licensed under CC0 1.0|This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication",
    "CDDL-1.1": "Common Development and Distribution License (CDDL) Version 1.1|Licensed under the Common Development and Distribution License, version 1.1",
    "CDDL-1.0": "Common Development and Distribution License (CDDL) Version 1.0|The contents of this file are subject to the terms of the Common Development and Distribution License",
    "EPL-1.0": "Eclipse Public License - v 1.0|This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "Eclipse Public License - v 2.0|This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EUPL-1.1": "Licensed under the EUPL, Version 1.1|European Union Public Licence v. 1.1",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2|European Union Public Licence v. 1.2",
    "GPL-1.0": "GNU General Public License Version 1, February 1989|This work is licensed under the GNU General Public License, version 1"
    "|This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version",
    "GPL-2.0": "GNU General Public License Version 2, June 1991|This work is licensed under the GNU General Public License, version 2|Licensed under the GNU GPL version 2|Licensed under the GPL version 2|This program is distributed under the terms of the GNU General Public License version 2"
    "|you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"
    "|This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0": "GNU General Public License Version 3, 29 June 2007|This work is licensed under the GNU General Public License, version 3|Licensed under the GNU GPL version 3|Licensed under the GPL version 3|This program is distributed under the terms of the GNU General Public License version 3"
    "|you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"
    "|This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": "Licensed under the ISC License|Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "LGPL-2.0": "GNU Library General Public License Version 2, June 1991|This work is licensed under the GNU Library General Public License, version 2"
    "|This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "LGPL-2.1": "GNU Lesser General Public License Version 2.1, February 1999|This work is licensed under the GNU Lesser General Public License, version 2.1"
    "|This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "LGPL-3.0": "GNU Lesser General Public License Version 3, 29 June 2007|This work is licensed under the GNU Lesser General Public License, version 3"
    "|This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "MIT": "Released under the MIT License|Licensed under the MIT License|under the MIT License|under the terms of the MIT License|Licensed under MIT|MIT licensed"
    "|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    "|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MPL-1.0": "Mozilla Public License Version 1.0|The contents of this file are subject to the Mozilla Public License Version 1.0",
    "MPL-1.1": "Mozilla Public License Version 1.1|The contents of this file are subject to the Mozilla Public License Version 1.1|Licensed under the Mozilla Public License, Version 1.1",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0|This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0|Mozilla Public License Version 2.0",
    "MS-PL": "Microsoft Public License (Ms-PL)|Licensed under the Microsoft Public License",
    "NCSA": "University of Illinois/NCSA Open Source License|Licensed under the NCSA Open Source License",
    "OFL-1.1": "SIL Open Font License Version 1.1 - 26 February 2007|This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted|Licensed under the PostgreSQL License",
    "Unlicense": "This is free and unencumbered software released into the public domain|Released under the Unlicense",
    "WTFPL": "Do What The Fuck You Want To Public License Version 2, December 2004|Licensed under the WTFPL",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely|Licensed under the zlib License",
}

#: Fixed values. Creative Commons licences: their short and long names, and their versions with what follows the number.
CREATIVE_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_COMMONS_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
TEMPLATES |= {
    f"CC-{kind}-{v}": f"Licensed under CC {kind} {v}|This work is licensed under a Creative Commons {name} {v} {area} License|Creative Commons {name} {v} {area} Public License"
    for kind, name in CREATIVE_COMMONS.items()
    for v, area in CREATIVE_COMMONS_VERSIONS.items()
}

#: Fixed values. Other identifiers that a tag may give.
OTHER_IDENTIFIERS = (
    "AFL-3.0", "BSD-1-Clause", "CC-BY-1.0", "CC-BY-SA-1.0", "CECILL-2.1", "ECL-2.0", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "LPPL-1.3c", "MIT-0", "MS-RL", "MulanPSL-2.0", "ODbL-1.0", "OSL-3.0", "PSF-2.0", "Python-2.0", "Ruby", "SSPL-1.0",
    "UPL-1.0", "Vim", "X11",
)

#: Fixed values. Words that turn a notice into its opposite when they stand before it in its clause; and what has such a word and is none.
NEGATIONS = (
    "not", "never", "no", "nor", "neither", "cannot", "none", "nothing", "nobody", "incompatible", "unlike", "formerly", "isn", "aren", "wasn", "weren", "hasn", "haven", "doesn", "didn", "don", "can't", "won't", "shouldn", "mustn",
)
NO_NEGATIONS = ("no warranty", "no warranties", "no liability", "no charge", "no cost", "no fee", "no restriction", "no restrictions", "not only", "not limited to")

#: Fixed values. Words that tell licences apart that share most others: a notice has just those of its template.
TELLING = ("affero", "lesser", "library general", "noncommercial", "noderivatives", "sharealike", "nc", "nd", "sa", "advertising materials", "neither the name")

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
