"""Cracking queries against what was put in, and cipher texts against published vectors."""

from lumentrace.functions import ciphers as C
from lumentrace.operators import crack
from lumentrace.plans import host_queries


def test_transpositions_are_found(spark, sf):
    rows = host_queries.crack_transpositions(spark, sf).collect()
    found = [r for r in rows if r.method is not None]
    assert len(found) > 0.5 * len(rows) and all(r.right for r in found)


def test_polyalphabetic_keys_are_found(spark, sf):
    rows = host_queries.crack_polyalphabetic(spark, sf).collect()
    assert sum(r.vigenere_key == "LEMON" for r in rows) > 0.5 * len(rows) and sum(r.beaufort_key == "SECRET" for r in rows) > 0.3 * len(rows)


def test_stream_ciphers_have_published_values():
    # RFC 6229, key 0x0102...10, offset 0
    assert C.rc4(bytes(16), "".join(map(chr, range(1, 17)))).hex() == "9ac7cc9a609d1ef7b2932899cde41b97"
    # RFC 8439, 2.1.1
    s = [0x11111111, 0x01020304, 0x9B8D6F43, 0x01234567]
    C._chacha_quarter(s, 0, 1, 2, 3)
    assert s == [0xEA2A92F4, 0xCB1CF8CE, 0x4581472E, 0x5881C4BB]
    # the Salsa20 specification, section 3
    s = [1, 0, 0, 0]
    C._salsa_quarter(s, 0, 1, 2, 3)
    assert s == [0x08008145, 0x80, 0x00010200, 0x20500000]


def test_letters_of_a_key_are_scored_like_whole_decodings():
    text = C.beaufort("the cat and the dog of the house are in the garden with all their friends and für she said " * 4, "LEMON")
    key = [3, 1, 4, 1, 5]
    words = crack._PlacedWords(text, 5, key)
    for i in range(5):
        want = [crack.language(C.beaufort(text, "".join(chr(65 + k) for k in key[:i] + [x] + key[i + 1 :])))[2] for x in range(26)]
        assert all(abs(a - b) < 1e-12 for a, b in zip(words.scores(i), want))
    words.change(2, 9)
    assert abs(words.best - crack.language(C.beaufort(text, "DBJBF"))[2]) < 1e-12


def test_a_climbed_key_that_refits_mirrored_letters_gives_way():
    text = "Thbleinst for shat anen of ennt inan ndtion in, from, iningor thsh ther haha, stou ndesen oran ble haen. write to user59@example.com about it"
    coded = C.encode("atbash", text)
    key = crack.beaufort_key(coded)
    assert key == "ZGAZZZZZZZZ" and crack.language(C.beaufort(coded, key))[2] > crack.language(text)[2], "two letters of the key win one word by chance"
    found = crack.crack(coded)
    assert (found["method"], found["key"], found["plaintext"]) == ("atbash", "", text)
    plain = "the cat and the dog of the house are in the garden with all their friends and she said that it was not for them " * 4
    assert crack.crack(C.vigenere(plain, "HHQHH", 1))["key"] == "HHQHH", "a key of almost one letter is still found"
    assert crack.crack(C.vigenere(plain, "LEMON", 1))["key"] == "LEMON"


def test_signs_read_back():
    for m in C.SYMBOL_METHODS:
        if m != "vowel_to_number":
            assert len(next(iter(C.SYMBOLS[m].values()))) >= 26 and C.decode(m, C.encode(m, "Every quick fox, jumps")) == "EVERY QUICK FOX, JUMPS"
