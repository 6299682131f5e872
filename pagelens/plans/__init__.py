"""How the parts of an audit are put together."""
