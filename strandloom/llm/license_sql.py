"""The licence scan in SQL, stated by itself: it takes neither patterns nor texts from the operator."""

# Digests of canonical forms of known licences.
DIGESTS = """
0BSD 0c9ef570c24a9d5127c4a0918a8a9164
0BSD 6a7ef7c79a0cc41871c5512e9f3cbbcb
0BSD 6ae2e877dc5167e19d0d91e7c2b3aded
Apache-2.0 a992dba1408433dcce3ed916e5e374bf
Apache-2.0 d34c325659ec2d17c02816c5b2b931b2
Apache-2.0 d4f93b2dc3cd79eb7a003005510f4d87
Apache-2.0 eb66ab19e5190d0ceb08453ce1057914
Artistic-1.0-Perl 164490624f060a0970a2312efb6a50da
BSD-2-Clause 0a8be92eebf1c853242c3ede1dc40dc4
BSD-2-Clause 0f7d8aeafc2bcbd7f6d11a95f74cb043
BSD-2-Clause 76d71fa1d882c38addd4adfcae1011b6
BSD-2-Clause 8b9ba851ed4c49547cf94078d081199a
BSD-2-Clause 9d7cfdae6f636a9262ee5d416fbac201
BSD-2-Clause b40dfd7775dde8e3b03235e83f56660f
BSD-3-Clause 02713b1135e16fca6d185e5121adfdf7
BSD-3-Clause 1c7e6717963c12abb98447d972cb620a
BSD-3-Clause 2b9a3b5e649ccb9fa0cbef139178e748
BSD-3-Clause 3b86f2d492ae5daaaada0847cc3a54aa
BSD-3-Clause 408af8ed288ec4d73208bc8b849fcca3
BSD-3-Clause 437042ec177f30cb954a8b28c8878063
BSD-3-Clause a54fe25ad5d417781888017cc57fe882
BSD-3-Clause ca8cc997baf4e7ebe220aecbd75651a5
BSL-1.0 14aa64457694d8ff14474b779de14bd4
BSL-1.0 62be19b8174bbd7bdfa15e42f2278118
CC-BY-4.0 a1bbfd172e0a2ce01c006b20ef04646c
CC-BY-NC-4.0 afd699b2837104a7129819d0af168481
CC-BY-SA-4.0 c862c1b85786c754cf189a5d417d08ee
CC0-1.0 c50672af8a1a16bc61170ece7fa5bd88
GFDL-1.2-only 1dc928922abdc779713cc986757f779c
GFDL-1.3-only 982be206076b770de11327d583f17eb9
GPL-1.0-only 7d5a06df9531ee3d1bb955f9e4458088
GPL-1.0-only ba6a338ed187b4b98612676b1bb23761
GPL-1.0-only ffc2b77e6d08514cd11158bb9da22146
GPL-2.0-only 08822ac541d390ed9068f320482bcb79
GPL-2.0-only bf9319c9120dac85146a1513bd045787
GPL-2.0-only d70aea05e218d502f9928315724fe042
GPL-2.0-only ec393342e130f557637181533e7a1286
GPL-3.0-only 0174b160fd3801e04be8c458ec5eee9a
GPL-3.0-only 2fdd5d2e4dbac4f1000f2541c8f8bb1c
GPL-3.0-only c1aa2b6297e433284e337f88c4066293
GPL-3.0-only feb071edba4ab85a18db606f164179eb
ISC 04824353aad4e5c13bb029897d53e5e8
ISC 213a16b5492c9d21c66b38c473297325
ISC 33e83d194689886ea5a00ce12140b6b4
ISC 415f675ba1f36cc62d90757fdb33ccc6
ISC 455099d616105392d08e93a79c7c118f
ISC 4f1394ee0ada8054bc99d04955c90506
ISC 50a805787f8e5b2ad758218256ca2f80
ISC 591b8fe5f3b7e23bf13027848082b7a6
ISC 6b269f2106bd5a6a6ba3b8eb43dbe21b
ISC 79074c6243eb3359cbf68ef58e08cb2c
ISC 7e8ef5ebc733dfad0a5eda3a3404bfa2
ISC 9c285856d77c5887dbebc6bab9a7e7df
ISC a0f39581f3571a6f88e692bc857e7cd8
ISC ccc1d85681464d1a85ab28aa6b413223
ISC e59fafed5608602f3294fdffd766a657
ISC faafd616a5e82b46866926c1911a9743
LGPL-2.0-only 4a321345a04593a7fee73c736a2b0d01
LGPL-2.0-only 8e2aed0597be0d9c8d157669be26a3e6
LGPL-2.0-only fcf6784178b91eab924a881207f97f2e
LGPL-2.1-only 10d1d86274204a890649689e6a60b8b7
LGPL-2.1-only 25e027d03e07d9141ceb79fe599507ad
LGPL-2.1-only c4fcf064f8711c2eeeb1c347ce8da2c6
LGPL-3.0-only 3dc77fe01fad042db24b945c344d4eed
MIT 1b98f599c96c6f5ab8965f4f30ebe3ed
MIT 20ee8e2447afd0cca617654bdc6244c4
MIT 23591f0878180acbfa06800a5717fb42
MIT b29ab87b4c7736a2b89f94b935e4539e
MIT ec649877c59b199ea43cd9e67c2a8aeb
MIT-0 b3da8eb62be107a7dd3512c182cd8012
MIT-0 f8e7469488098a4058dcf08f3f81dca6
MPL-1.1 916b4efd26bae07f153142c30fe8a90b
MPL-2.0 16460510b00814a71821aed7224f44d2
Unlicense 1643f0e428e214e3c0c086a3b5e30aed
Unlicense 1c9cebe350e52205cac7464f62c5b778
Unlicense 3b14b10fdc4b01e7c1b9328ba351889f
Unlicense 4b73d1c891b5640fcd72edfbb06cc06a
Unlicense 6247d9f9a856f273f44088c53e3520dd
Unlicense f73dec343c21b54a9e60789e7c8ca22a
Zlib 269be96116582b39b23a75c6953fd65c
Zlib 44dffbac34fb8125ff1fffa91b2074f0
Zlib b1b4bd61e3babb47450b5132dac1b982
"""

# Canonical forms of one-line notices.
LINES = """
CC-BY-4.0 licensedunderccby40
CC-BY-NC-4.0 licensedunderccbync40
CC-BY-SA-4.0 licensedunderccbysa40
Apache-2.0 licensedundertheapachelicenseversion20
MIT releasedunderthemitlicense
GPL-2.0-only thisworkislicensedunderthegnugeneralpubliclicenseversion2
GPL-3.0-only thisworkislicensedunderthegnugeneralpubliclicenseversion3
"""


def _values(table: str) -> str:
    return ", ".join("('{}', '{}')".format(*row.split(" ")) for row in table.strip().split("\n"))


_SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authoris", "authoriz"),
    ("centre", "center"),
    ("copyrightholder", "copyrightowner"),
    ("favour", "favor"),
    ("fulfill", "fulfil"),
    ("initialis", "initializ"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("organis", "organiz"),
    ("whilst", "while"),
    ("willful", "wilful"),
]


def _spelled(form: str) -> str:
    for was, now in _SPELLINGS:
        form = f"replace({form}, '{was}', '{now}')"
    return form


_NOTICE = (
    r"\n[ \t/*#;>%.-]*(?:(?i:copyright)[ \t]*(?:\((?i:c)\)|©|:|<|\[|\{|[0-9]{4})"
    r"|(?i:copyright)[ \t]+(?:[Tt]he[ \t]+)?[A-Z][A-Za-z.]*[a-z][^\n]*(?i:contributors|authors|developers|foundation|inc[.]|all rights reserved)"
    r"|\((?i:c)\)[ \t]*(?:(?i:copyright)[ \t]*)?[0-9]{4}|©|(?i:all rights reserved))[^\n]*"
)
_FORM = f"regexp_replace(lower(regexp_replace(chr(10) || coalesce(text, ''), '{_NOTICE}', chr(10), 'g')), '[^\\p{{L}}\\p{{N}}\\n]+', '', 'g')"
_WHOLE = f"regexp_replace({_spelled('replace(form, chr(10), chr(39) || chr(39))')}, 'neitherthenameof[\\p{{L}}\\p{{N}}]{{1,120}}?northenames', 'neitherthenameofnorthenames', 'g')".replace("chr(39) || chr(39)", "''")

LICENSE_SQL = f"""
    WITH known AS (SELECT * FROM (VALUES {_values(DIGESTS)}) AS t(license_id, digest)
    ), notices AS (SELECT * FROM (VALUES {_values(LINES)}) AS t(license_id, line)
    ), forms AS (SELECT row_number() OVER () AS row, doc_id, {_FORM} AS form FROM documents
    ), lines AS (SELECT row, {_spelled("line")} AS line FROM (SELECT row, unnest(string_split(form, chr(10))) AS line FROM forms) WHERE length(line) <= 200
    ), found AS (
        SELECT row, string_agg(license_id, ',' ORDER BY license_id) AS ids
        FROM (SELECT DISTINCT row, license_id FROM lines JOIN notices USING (line)) GROUP BY row
    ), wholes AS (SELECT row, doc_id, {_WHOLE} AS whole FROM forms
    ), digests AS (SELECT row, doc_id, CASE WHEN whole <> '' THEN md5(whole) END AS text_digest FROM wholes)
    SELECT doc_id, text_digest, license_id, coalesce(ids, '') AS notice_ids
    FROM digests LEFT JOIN known ON text_digest = digest LEFT JOIN found USING (row)
"""
