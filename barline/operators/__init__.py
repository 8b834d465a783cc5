"""barline.operators"""
