"""Unicode emoji code points (public emoji-data) as ranges."""

# Pictographs of the basic plane.
BASIC = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 "
    "25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 "
    "262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F "
    "2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 "
    "26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 "
    "2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 "
    "27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299"
)

# Pictographs beyond the basic plane, without skin tones and flag letters.
ASTRAL = (
    "1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A "
    "1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 "
    "1F3F7-1F3FA 1F400-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 "
    "1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 "
    "1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 "
    "1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 "
    "1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8"
)

# Basic-plane pictographs shown as emoji without a variation selector.
EMOJI_STYLE = (
    "231A-231B 23E9-23EC 23F0 23F3 25FD-25FE 2614-2615 2648-2653 267F 2693 26A1 26AA-26AB "
    "26BD-26BE 26C4-26C5 26CE 26D4 26EA 26F2-26F3 26F5 26FA 26FD 2705 270A-270B 2728 274C 274E "
    "2753-2755 2757 2795-2797 27B0 27BF 2B1B-2B1C 2B50 2B55"
)

# Pictographs beyond the basic plane that need a variation selector.
TEXT_STYLE = (
    "1F170-1F171 1F17E-1F17F 1F202 1F237 1F321 1F324-1F32C 1F336 1F37D 1F396-1F397 1F399-1F39B "
    "1F39E-1F39F 1F3CB-1F3CE 1F3D4-1F3DF 1F3F3 1F3F5 1F3F7 1F43F 1F441 1F4FD 1F549-1F54A "
    "1F56F-1F570 1F573-1F579 1F587 1F58A-1F58D 1F590 1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 "
    "1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA 1F6CB 1F6CD-1F6CF 1F6E0-1F6E5 "
    "1F6E9 1F6F0 1F6F3"
)

# Skin tones U+1F3FB..U+1F3FF in order.
SKIN_TONES = ("light", "medium-light", "medium", "medium-dark", "dark")

# Common short names that differ from the Unicode character name.
ALIASES = {
    "❤": "red_heart", "👍": "thumbs_up", "👎": "thumbs_down", "👏": "clapping_hands",
    "🙏": "folded_hands", "💪": "flexed_biceps", "👋": "waving_hand", "👌": "OK_hand",
    "😁": "beaming_face_with_smiling_eyes", "😃": "grinning_face_with_big_eyes",
    "😄": "grinning_face_with_smiling_eyes", "😅": "grinning_face_with_sweat",
    "😆": "grinning_squinting_face", "😇": "smiling_face_with_halo",
    "😈": "smiling_face_with_horns", "😍": "smiling_face_with_heart-eyes",
    "😋": "face_savoring_food", "😑": "expressionless_face", "😒": "unamused_face",
    "😓": "downcast_face_with_sweat", "😔": "pensive_face", "😖": "confounded_face",
    "😘": "face_blowing_a_kiss", "😛": "face_with_tongue", "😜": "winking_face_with_tongue",
    "😝": "squinting_face_with_tongue", "😠": "angry_face", "😡": "enraged_face",
    "😤": "face_with_steam_from_nose", "😥": "sad_but_relieved_face",
    "😨": "fearful_face", "😩": "weary_face", "😪": "sleepy_face", "😫": "tired_face",
    "😬": "grimacing_face", "😰": "anxious_face_with_sweat", "😱": "face_screaming_in_fear",
    "😲": "astonished_face", "😳": "flushed_face", "😵": "face_with_crossed-out_eyes",
    "😷": "face_with_medical_mask", "🤗": "smiling_face_with_open_hands",
    "🤔": "thinking_face", "🤐": "zipper-mouth_face", "☺": "smiling_face",
    "☹": "frowning_face", "✌": "victory_hand", "✈": "airplane", "💯": "hundred_points",
    "💔": "broken_heart", "💋": "kiss_mark", "🎂": "birthday_cake", "🌹": "rose",
    "💩": "pile_of_poo", "👊": "oncoming_fist", "✊": "raised_fist", "✋": "raised_hand",
    "☝": "index_pointing_up", "👇": "backhand_index_pointing_down",
    "👆": "backhand_index_pointing_up", "👈": "backhand_index_pointing_left",
    "👉": "backhand_index_pointing_right", "⭐": "star", "⚡": "high_voltage",
    "🤦": "person_facepalming", "🤷": "person_shrugging", "🙈": "see-no-evil_monkey",
    "🙉": "hear-no-evil_monkey", "🙊": "speak-no-evil_monkey", "♂": "male_sign",
    "♀": "female_sign", "☀": "sun", "💗": "growing_heart",
}
