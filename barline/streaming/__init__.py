"""barline.streaming"""
