from .draw import draw, draw_int, draw_slots
from .arrays import bind, int_text, num_text, pad, text_join

__all__ = ["bind", "draw", "draw_int", "draw_slots", "int_text", "num_text", "pad", "text_join"]
