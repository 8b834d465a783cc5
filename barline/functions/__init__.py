"""barline.functions"""
