"""Record layouts and closed vocabularies.

``chat_id`` is a string when it comes from a file name and a bigint in ready-made tables; operators
never look at its type.
"""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("chat_id",)


def messages(chat_id: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("chat_id", chat_id or T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("sender", T.StringType()),
            T.StructField("receiver", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("type", T.StringType()),
        ]
    )


def calls(chat_id: T.DataType | None = None) -> T.StructType:
    return T.StructType(
        [
            T.StructField("chat_id", chat_id or T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("sender", T.StringType()),
            T.StructField("receiver", T.StringType()),
            T.StructField("duration", T.IntegerType()),
            T.StructField("type", T.StringType()),
            T.StructField("group_call_invites", T.IntegerType()),
            T.StructField("silence_reason", T.StringType()),
            T.StructField("ts", T.TimestampNTZType()),
        ]
    )


TOXICITY = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("type", T.StringType())]
)

# Message types by export format.
IOS_MESSAGE_TYPES = (
    "text", "image", "audio", "video", "gif", "sticker", "contact_card", "location", "document",
    "deleted_by_me", "deleted_by_others", "blocked", "unblocked", "text_edited_message", "unknown",
)
ANDROID_MESSAGE_TYPES = ("text", "media", "unknown")

# Call types; the second tuple counts as missed by the receiver.
CALL_TYPES = (
    "voice_call", "video_call", "missed_voice_call", "missed_video_call", "failed_call",
    "group_call", "silenced_voice_call", "silenced_video_call",
)
MISSED_CALL_TYPES = (
    "missed_voice_call", "missed_video_call", "silenced_voice_call", "silenced_video_call",
)

# Sentiment labels in model order with their numeric value.
SENTIMENTS = {"Very Negative": -2, "Negative": -1, "Neutral": 0, "Positive": 1, "Very Positive": 2}

# Bin labels of the weekly heat map, low to high.
MOOD_BINS = tuple(SENTIMENTS)
TOXICITY_BINS = ("Very Low", "Low", "Moderate", "High", "Very High")

# Emotion labels in model order.
EMOTIONS = (
    "admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion",
    "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment",
    "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism", "pride",
    "realization", "relief", "remorse", "sadness", "surprise", "neutral",
)

# Emotions that make up the love and the hate score.
LOVE_EMOTIONS = ("love", "caring")
HATE_EMOTIONS = ("anger", "annoyance")

# Labels of the toxicity model and languages of the detector, in model order.  Both are
# parameters; these are the defaults.
TOXICITY_LABELS = (
    "toxicity", "severe_toxicity", "obscene", "identity_attack", "insult", "threat",
    "sexual_explicit",
)
LANGUAGES = (
    "ar", "bg", "de", "el", "en", "es", "fr", "hi", "it", "ja", "nl", "pl", "pt", "ru", "sw",
    "th", "tr", "ur", "vi", "zh",
)
CHAT_LANGUAGES = ("hi", "en")
