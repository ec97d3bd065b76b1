"""DataFrame-in, DataFrame-out operators over lines, messages, calls and scored contexts."""
