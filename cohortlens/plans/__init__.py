"""The studies composed from operators; ``registry`` gathers their queries."""
