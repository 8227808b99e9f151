"""Tables as racing views."""
